"""Dense, lexical and fused retrieval, batched by query."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.functions import text as tx
from corpusmith.scratch import save, spread

#: Fusion constant, candidates per list, results, graph weight and seeds, recency midpoint in days.
RRF_K, CANDIDATES, RESULTS, GRAPH_WEIGHT, GRAPH_SEEDS, RECENCY_DAYS = 60, 40, 10, 0.25, 5, 30
#: Fixed value: the rank of an item that a zero-based list lacks.
ABSENT = 1_000_000
K1, B = 1.2, 0.75
#: Query rows, and components of query vectors, that may be sent to all tasks at once.
MOST_QUERIES, BATCH_CELLS = 10_000, 1 << 21


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def checked(queries: DataFrame) -> DataFrame:
    """A query batch to broadcast, its size proven."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in a batch")
    return F.broadcast(queries)


def sized(rows: DataFrame) -> DataFrame:
    """Rows to broadcast if a count proves them few; Spark joins them by shuffle otherwise."""
    return F.broadcast(rows) if rows.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES else rows


def top(rows: DataFrame, k: int, score: str = "score", by: str = "query_id", ties: str = "chunk_id") -> DataFrame:
    """The k best rows of each query with their rank from 1; ranks are limited within partitions first."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): the cosine of every vector (chunk_id, vector, ...)
    with every query (query_id, vector), in one scan of the vectors. Vectors without a
    direction (null, all zero, with a null in them) take no part."""
    norm = lambda c: F.sqrt(_dot(F.col(c), F.col(c)))
    q = checked(queries.select("query_id", F.col("vector").alias("asked"), norm("vector").alias("asked_norm")).where("asked_norm > 0"))
    # Norms are a column on either side, made once for each vector and not for each pair.
    rows = vectors.withColumn("norm", norm("vector")).where("norm > 0").crossJoin(q)
    return rows.select("query_id", "chunk_id", (_dot(F.col("vector"), F.col("asked")) / (F.col("norm") * F.col("asked_norm"))).alias("score"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to at least width."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(lengths.max(initial=0)))
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; those without a direction become NaN."""
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, initial=0)[:, None]
        return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _best(sent, k: int):
    """Each query's k best rows of those that a task sees, a batch and part at a time as one matrix product."""

    def batches(it):
        asked = sent.value.combine_chunks()
        ids, parts = asked.column("query_id").combine_chunks(), asked.column("parts").to_pylist()
        q = units(matrix(asked.column("vector").combine_chunks(), 0))
        best = [(np.empty(0), []) for _ in parts]
        for batch in it:
            x = units(matrix(batch.column(1), q.shape[1]))
            sound, part = ~np.isnan(x).any(axis=1), batch.column(2).to_numpy()
            wide = np.pad(q, ((0, 0), (0, x.shape[1] - q.shape[1])))
            for p in np.unique(part[sound]):
                here = np.flatnonzero(sound & (part == p))
                there = np.array([n for n, want in enumerate(parts) if want is None or p in want], np.int64)
                names = batch.column(0).take(pa.array(here))
                for at, row in zip(there, wide[there] @ x[here].T):
                    old, old_names = best[at]
                    # Ranks go by nine places, so what equals the kth score there may still enter by its id.
                    pick = np.flatnonzero(row >= (old[k - 1] - 1e-8 if len(old) >= k else -2.0))
                    if len(pick) > 8 * k:
                        pick = pick[row[pick] >= np.partition(row[pick], len(pick) - k)[len(pick) - k] - 1e-8]
                    if len(pick):
                        new = zip(row[pick].tolist(), names.take(pa.array(pick)).to_pylist())
                        rows = sorted([*zip(old.tolist(), old_names), *new], key=lambda r: (-round(r[0], 9), r[1]))[:k]
                        best[at] = (np.array([r[0] for r in rows]), [r[1] for r in rows])
        filled = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        if len(filled):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(filled)), pa.array([n for _, names in best for n in names], batch.schema.types[0]), pa.array(np.concatenate([s for s, _ in best]))], ["query_id", "chunk_id", "score"])

    return batches


def scan(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest by cosine of each query (query_id, vector, parts array<int>) among
    the rows (chunk_id, vector, part int) of its parts, all of them where that is null. Queries are sent to all tasks
    in batches of at most BATCH_CELLS components; each task keeps the best k of its own rows. Vectors without a
    direction (null, all zero, with a null or a component that is not finite) take no part."""
    spark = rows.sparkSession
    doubles = F.col("vector").cast("array<double>").alias("vector")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    asked = save(queries.where(F.coalesce(sound, F.lit(False))).select("query_id", doubles, "parts"), "scan-queries")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    there = rows.where(F.coalesce(sound, F.lit(False))).select("chunk_id", doubles, "part")
    fields = [T.StructField(c, t.schema[c].dataType) for t, c in ((asked, "query_id"), (there, "chunk_id"))] + [T.StructField("score", T.DoubleType())]
    parts = max(1, math.ceil(size.n * (size.width or 1) / BATCH_CELLS))
    found = []
    for p in range(parts):
        batch = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) if parts > 1 else asked
        sent = spark.sparkContext.broadcast(batch.toArrow())
        here = top(there.mapInArrow(_best(sent, k), T.StructType(fields)), k)
        if parts == 1:
            return here
        found.append(save(here, "scan-part"))
        sent.destroy()
    return functools.reduce(DataFrame.unionByName, found)


def dense(vectors: DataFrame, queries: DataFrame, k: int = RESULTS) -> DataFrame:
    """Exact cosine search of vectors (chunk_id, vector) for queries (query_id, vector)."""
    return scan(vectors.withColumn("part", F.lit(0)), queries.withColumn("parts", F.lit(None).cast("array<int>")), k)


def dense_scoped(vectors: DataFrame, owners: DataFrame, queries: DataFrame, k: int = RESULTS) -> DataFrame:
    """The same where a query (query_id, vector, tenant) sees its own tenant's chunks only. owners: (chunk_id, tenant int)."""
    mine = vectors.join(owners.select("chunk_id", F.col("tenant").alias("part")), "chunk_id")
    return scan(mine.where("part is not null"), queries.where("tenant is not null").withColumn("parts", F.array(F.col("tenant").cast("int"))), k)


def postings(chunks: DataFrame, terms: list[str], *more: str) -> DataFrame:
    """(chunk_id, more..., length, terms): the asked terms among each chunk's words, repeats included."""
    words = spread(chunks.select("chunk_id", *more, "content")).select("chunk_id", *more, tx.tokens(F.col("content")).alias("words"))
    return words.select("chunk_id", *more, F.size("words").alias("length"), F.filter("words", lambda w: w.isin(terms)).alias("terms"))


def bm25(chunks: DataFrame, queries: list[tuple[int, str]], k: int = CANDIDATES) -> DataFrame:
    return top(bm25_scores(chunks, queries), k)


def bm25_scores(chunks: DataFrame, queries: list[tuple[int, str]], tenants: dict[int, int] | None = None) -> DataFrame:
    """BM25 over lower-cased words without stemming. queries: (query_id, text). With tenants, by query_id, a query scores its
    own tenant's chunks alone; frequencies are those of all."""
    scope = [] if tenants is None else ["tenant"]
    asked = sorted({(q, w) for q, text in queries for w in _words(text)})
    # Texts are split once: statistics and scores both read what is written down here.
    held = save(postings(chunks, sorted({w for _, w in asked}), *scope), "postings")
    # One pass for all statistics: a row for each asked term and one, of a blank term, for the corpus.
    seen = held.select("length", F.explode(F.concat(F.array(F.lit("")), F.array_distinct("terms"))).alias("term"))
    stats = {r.term: r for r in seen.groupBy("term").agg(F.count("*").alias("n"), F.sum("length").alias("length")).collect()}
    n, total = (stats[""].n, stats[""].length) if stats else (0, 0)
    df = {t: r.n for t, r in stats.items()}
    weights = [(q, t, math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)), (tenants or {}).get(q)) for q, t in asked if t in df]
    # As many rows as the query batch has words.
    terms = F.broadcast(chunks.sparkSession.createDataFrame(weights, "query_id int, term string, idf double, tenant int").select("query_id", "term", "idf", *scope))
    found = held.where(F.size("terms") > 0).select("chunk_id", *scope, "length", "terms", F.explode(F.array_distinct("terms")).alias("term"))
    tf = F.size(F.filter("terms", lambda x: x == F.col("term")))
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") * n / max(1, total)))
    rows = found.select("chunk_id", *scope, "term", part.alias("part")).join(terms, ["term", *scope])
    return rows.groupBy("query_id", "chunk_id").agg(F.sum(F.col("idf") * F.col("part")).alias("score"), F.count("*").alias("n_terms"))


def _words(text: str) -> list[str]:
    import re

    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


def matches_all(chunks: DataFrame, queries: list[tuple[int, str]]) -> DataFrame:
    """(query_id, chunk_id) where every query word occurs."""
    wanted = {q: sorted(set(_words(t))) for q, t in queries}
    held = postings(chunks, sorted({w for words in wanted.values() for w in words}))
    fits = F.array(*(F.when(F.size(F.array_except(F.array(*map(F.lit, words)) if words else F.array().cast("array<string>"), "terms")) == 0, F.lit(q)) for q, words in wanted.items()))
    return held.select("chunk_id", F.explode(F.array_compact(fits)).alias("query_id")).select("query_id", "chunk_id")


def scope(ranked: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Scored rows whose chunk belongs to the query's tenant."""
    owned = chunks.select("chunk_id", "tenant").join(checked(queries.select("query_id", "tenant")), "tenant").select("query_id", "chunk_id")
    return ranked.join(owned, ["query_id", "chunk_id"], "left_semi")


def fuse(dense_ranked: DataFrame, lexical_ranked: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: ranks from 1, a missing one adds nothing."""
    d = dense_ranked.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    x = lexical_ranked.select("query_id", "chunk_id", F.col("rank").alias("lex_rank"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    return d.join(x, ["query_id", "chunk_id"], "full_outer").withColumn("score", part("dense_rank") + part("lex_rank"))


def blend(lexical: DataFrame, chunks: DataFrame, recency: float, quality: float) -> DataFrame:
    """Lexical scores plus weighted recency and quality. chunks: (chunk_id, age_days, quality)."""
    decay = F.lit(float(RECENCY_DAYS)) / (F.greatest(F.col("age_days"), F.lit(0)) + RECENCY_DAYS)
    rows = lexical.join(chunks.select("chunk_id", "age_days", "quality"), "chunk_id")
    return rows.select("query_id", "chunk_id", (F.col("score") + recency * decay + quality * F.coalesce("quality", F.lit(0))).alias("score"))


def fuse_zero_based(lists: DataFrame, k: int = RRF_K, texts: DataFrame | None = None, negatives: DataFrame | None = None) -> DataFrame:
    """Fusion of lists (query_id, list 'dense' or 'lex', pos from 0, id): a missing
    item has rank ABSENT, the first place of a repeated one counts, ties go by id.
    texts (id, content) and negatives (query_id, terms) halve what holds a negative."""
    first = lists.groupBy("query_id", "id").pivot("list", ["dense", "lex"]).agg(F.min("pos"))
    part = lambda c: 1.0 / (k + F.coalesce(F.col(c), F.lit(ABSENT)))
    rows = first.select("query_id", "id", (part("dense") + part("lex")).alias("score"))
    if negatives is not None:
        rows = rows.join(sized(negatives), "query_id", "left")
        rows = rows.join(texts, "id", "left") if texts is not None else rows.withColumn("content", F.lit(None).cast("string"))
        hit = F.coalesce(tx.holds_any(F.coalesce("content", "id"), F.col("terms")), F.lit(False))
        rows = rows.select("query_id", "id", F.when(hit, F.col("score") * 0.5).otherwise(F.col("score")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return rows.withColumn("rank", F.row_number().over(order))


def confidence_tier(rows: DataFrame, by: str = "query_id") -> DataFrame:
    """(query_id, tier) from rows (score, rerank_score, match_source): reranked
    scores decide where there are any, else dense ones, else fused ones."""
    best = rows.groupBy(by).agg(F.max("rerank_score").alias("r"), F.max(F.when(F.col("match_source") == "dense", F.col("score"))).alias("d"), F.max("score").alias("s"))

    def scale(col, low, medium):
        return F.when(col < low, "low").when(col < medium, "medium").otherwise("high")

    tier = F.when(F.col("r").isNotNull(), scale(F.col("r"), -2.0, 0.0)).when(F.col("d").isNotNull(), scale(F.col("d"), 0.55, 0.7)).when(F.col("s").isNotNull(), scale(F.col("s"), 0.012, 0.020))
    return best.select(by, tier.alias("tier")).fillna("insufficient", ["tier"])


def gate(dense_ranked: DataFrame, hybrid_ranked: DataFrame, rows: int = 5, least: float = 0.5) -> DataFrame:
    """Each query's dense rows where there are enough and the best is good enough, its hybrid rows otherwise."""
    state = dense_ranked.groupBy("query_id").agg((F.count("*") >= rows).alias("many"), (F.max("score") >= least).alias("good"))
    passed = state.where("many and good").select("query_id")
    d = dense_ranked.join(passed, "query_id", "left_semi").select("query_id", "chunk_id", "score", F.lit("dense").alias("match_source"))
    h = hybrid_ranked.join(passed, "query_id", "left_anti").select("query_id", "chunk_id", "score", F.lit("hybrid").alias("match_source"))
    return d.unionByName(h)


def negate(rows: DataFrame, terms) -> DataFrame:
    """Rows (query_id, rank, content) re-scored by place, halved where a negative term occurs."""
    hit = tx.holds_any(F.col("content"), terms)
    base = 2.0 / (RRF_K + F.col("rank") - 1)
    return rows.withColumn("score", F.when(hit, base * 0.5).otherwise(base))


def rerank(rows: DataFrame, k: int) -> DataFrame:
    """Stand-in for a cross-encoder: log-odds-like overlap of query words with the
    content. rows: (query_id, query, chunk_id, content)."""
    q, c = F.array_distinct(tx.tokens(F.col("query"))), tx.tokens(F.col("content"))
    share = F.size(F.array_intersect(q, c)) / F.greatest(F.size(q), F.lit(1))
    return top(rows.withColumn("rerank_score", 8 * share - 4), k, "rerank_score")


def middle_last(rows: DataFrame) -> DataFrame:
    """Prompt places that put the best rows at both ends. rows: (query_id, rank from 1)."""
    i, n = F.col("rank") - 1, F.count("*").over(Window.partitionBy("query_id"))
    return rows.withColumn("slot", F.when(i % 2 == 0, F.floor(i / 2)).otherwise(n - 1 - F.floor((i - 1) / 2)).cast("long"))


#: Contexts of a prompt, characters of one (at most, and at least while there is room), of all, and of a fingerprint.
PROMPT_ROWS, PROMPT_CHARS, PROMPT_LEAST, PROMPT_TOTAL, PRINT_CHARS = 3, 1000, 250, 3000, 500


def compress(rows: DataFrame, most: int = PROMPT_ROWS) -> DataFrame:
    """(query_id, rank, content, token_count) of the contexts that fit a prompt. rows: (query_id, rank, doc_id string,
    content), a query's few candidates. Taken in order while there is room: no text twice, and one of each document
    beyond the first."""
    made = rows.select("query_id", "rank", tx.canonical_id(F.col("doc_id")).alias("doc"), tx.distinct_sentences(F.coalesce("content", F.lit(""))).alias("text"))
    per_query = made.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc", "text"))).alias("rows"))
    out = "array<struct<rank:int,content:string,token_count:int,doc:string,print:string>>"

    def step(state, row):
        used = F.aggregate(state, F.lit(0), lambda n, x: n + F.length(x["content"]))
        room = F.greatest(F.lit(PROMPT_LEAST), F.least(F.lit(PROMPT_CHARS), PROMPT_TOTAL - used))
        text = tx.cut_context(row["text"], room)
        print_ = tx.fingerprint(F.substring(text, 1, PRINT_CHARS))
        known = F.exists(state, lambda x: ((print_ != "") & (x["print"] == print_)) | ((row["doc"] != "") & (x["doc"] == row["doc"])))
        more = F.array(F.struct(row["rank"].cast("int").alias("rank"), text.alias("content"), tx.rough_tokens(text).alias("token_count"), row["doc"].alias("doc"), print_.alias("print"))).cast(out)
        return F.when((F.size(state) >= most) | (used >= PROMPT_TOTAL) | known, state).otherwise(F.concat(state, more))

    taken = per_query.select("query_id", F.explode(F.aggregate("rows", F.array().cast(out), step)).alias("x"))
    return taken.select("query_id", "x.rank", "x.content", "x.token_count")


def depth_trim(rows: DataFrame, depths: DataFrame) -> DataFrame:
    """Gated rows (query_id, chunk_id, score, match_source): of hybrid ones the best as many as the depth
    (query_id, depth) says where that is 1 or 2; dense ones all."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    ranked = rows.join(depths, "query_id").withColumn("place", F.row_number().over(order))
    return ranked.where((F.col("match_source") == "dense") | (F.col("depth") > 2) | (F.col("place") <= F.col("depth"))).drop("place", "depth")


def explained(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Gated rows (query_id, chunk_id, score, match_source) with their place, the source (chunk_id, document_id, source_url) each comes
    from, and how their query was answered: mode and how many rows there are."""
    query, order = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    placed = rows.withColumns({"place": F.row_number().over(order), "mode": F.max("match_source").over(query), "n_rows": F.count("*").over(query)})
    return placed.join(sources.select("chunk_id", "document_id", "source_url"), "chunk_id", "left")


def negate_reranked(rows: DataFrame, terms, penalty: float = 2.0) -> DataFrame:
    """Re-ranked rows (query_id, chunk_id, content, rerank_score, score): what holds a negative term loses `penalty` of
    its rerank score and half of its score; places anew by rerank score, where there is one, else by score."""
    hit = tx.holds_any(F.col("content"), terms)
    rows = rows.withColumns({"rerank_score": F.when(hit, F.col("rerank_score") - penalty).otherwise(F.col("rerank_score")), "score": F.when(hit, F.col("score") * 0.5).otherwise(F.col("score"))})
    by = F.round(F.coalesce("rerank_score", "score"), 9)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "chunk_id")))
