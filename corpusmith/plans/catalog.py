"""Registry of named queries; their SQL twins are in corpusmith.plans.sql."""

from __future__ import annotations

import datetime
import hashlib
import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmith import corpus
from corpusmith.deploy import shipped
from corpusmith.functions import sequential
from corpusmith.functions import text as tx
from corpusmith.llm.common import small
from corpusmith.operators import cells, concepts, evaluate, fulltext, graph, middleware, phases, retrieval, service, tables
from corpusmith.plans import functions, sql
from corpusmith.scratch import save, scratch_root
from corpusmith.sources import readers, scans, sinks
from corpusmith.streaming import flows, state

QUERIES: dict = {}

#: Fixed inputs of the queries that judge questions and error texts.
QUESTIONS = ["What is Postgres?", "How does auth depend on tokens?", "Trace the lineage of chunks", "who calls the parser", "impact of the schema change", "define vector search", "FastAPI authentication NOT OAuth2", "PostgreSQL vector search -pinecone -weaviate", "LLM inference without transformers except onnx", "between ingest and query", "list all settings"]
ERROR_TEXTS = ["Request timed out", "HTTP 429 too many", "422 String should have at most 10", "client error", "malformed JSON", "eval_failed", "missing field", "odd", None]
TOC = "# Doc\n\n## Table of Contents\n- [A](#a)\n- [B](#b)\n- [C](#c)\n\n## A\ntext\n\n### Index\nmore"
#: Fixed value: requests a minute.
RATE_LIMIT = 120
TRADE_HOPS, WATERMARK = 2, datetime.datetime(1998, 1, 1)


def query(f):
    QUERIES[f.__name__] = shipped(f)
    return f


def rounded(col, places: int = 6):
    return F.round(col, places)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_scores(corpus.chunks(spark, sf_dir), corpus.QUERIES)


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieval.dense(_vectors(spark, sf_dir), corpus.centroids(spark, sf_dir), k)


def _lexical(spark: SparkSession, sf_dir: str, k: int = retrieval.CANDIDATES) -> DataFrame:
    return retrieval.bm25(corpus.chunks(spark, sf_dir), corpus.QUERIES, k)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(_dense(spark, sf_dir, retrieval.CANDIDATES), _lexical(spark, sf_dir))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "chunk_id", "rank", rounded("score").alias("score"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as markdown of two sections: the text below its language, then the source."""
    parts = [F.lit("# "), F.coalesce("lang", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n## Source\n\n"), F.coalesce("source", F.lit(""))]
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))


@query
def dense_top10(spark, sf_dir):
    return _ranked(_dense(spark, sf_dir, retrieval.RESULTS))


@query
def dense_rows_top10(spark, sf_dir):
    """Every row whose id is divisible by 100 against all rows, itself among them."""
    return _ranked(retrieval.dense(_vectors(spark, sf_dir), _asked_rows(spark, sf_dir)))


def _asked_rows(spark, sf_dir):
    return _vectors(spark, sf_dir).where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "vector")


@query
def cell_index_top10(spark, sf_dir):
    """The same rows by the index of k-means cells, with as many probes as a recall of 0.95 needs."""
    index, asked = cells.build(_vectors(spark, sf_dir)), _asked_rows(spark, sf_dir)
    return _ranked(cells.search(index, asked, probes=cells.probes_for(index, asked)))


@query
def fts_rank_top40(spark, sf_dir):
    """The first three words of every document whose id is divisible by 100, as a query to the stemmed index of all."""
    chunks = corpus.chunks(spark, sf_dir)
    words = F.slice(tx.tokens(F.col("content")), 1, 3)
    asked = chunks.where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), F.array_join(words, " ").alias("query"))
    return _ranked(fulltext.ranked(fulltext.read(spark, fulltext.build(chunks.select("chunk_id", "content"))), asked))


@query
def bm25_top40(spark, sf_dir):
    return _ranked(_lexical(spark, sf_dir))


@query
def fts_and_match(spark, sf_dir):
    return retrieval.matches_all(corpus.chunks(spark, sf_dir), corpus.QUERIES).groupBy("query_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_chunk"))


@query
def hybrid_rrf_sql(spark, sf_dir):
    return _ranked(retrieval.top(_fused(spark, sf_dir), retrieval.RESULTS))


@query
def hybrid_rrf_scoped(spark, sf_dir):
    """Queries meet the chunks of their own tenant alone, before anything is scored."""
    chunks, tenants = corpus.chunks(spark, sf_dir), {q: q % corpus.TENANTS for q, _ in corpus.QUERIES}
    asked = corpus.centroids(spark, sf_dir).join(F.broadcast(corpus.text_queries(spark).select("query_id", "tenant")), "query_id")
    d = retrieval.dense_scoped(_vectors(spark, sf_dir), chunks.select("chunk_id", "tenant"), asked, retrieval.CANDIDATES)
    x = retrieval.top(retrieval.bm25_scores(chunks, corpus.QUERIES, tenants), retrieval.CANDIDATES)
    return _ranked(retrieval.top(retrieval.fuse(d, x), retrieval.RESULTS))


@query
def hybrid_rrf_attr(spark, sf_dir):
    labels = corpus.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    chunks = corpus.chunks(spark, sf_dir).select("chunk_id", "age_days").join(labels, "chunk_id", "left")
    blended = retrieval.top(retrieval.blend(_lexical_scores(spark, sf_dir), chunks, 0.5, 0.3), retrieval.CANDIDATES)
    return _ranked(retrieval.top(retrieval.fuse(_dense(spark, sf_dir, retrieval.CANDIDATES), blended), retrieval.RESULTS))


def _lists(spark, sf_dir):
    d = _dense(spark, sf_dir, retrieval.CANDIDATES).select("query_id", F.lit("dense").alias("list"), (F.col("rank") - 1).alias("pos"), F.col("chunk_id").cast("string").alias("id"))
    x = _lexical(spark, sf_dir).select("query_id", F.lit("lex").alias("list"), (F.col("rank") - 1).alias("pos"), F.col("chunk_id").cast("string").alias("id"))
    return d.union(x)


@query
def rrf_zero_based(spark, sf_dir):
    return retrieval.fuse_zero_based(_lists(spark, sf_dir)).select("query_id", "id", "rank", rounded("score", 9).alias("score"))


@query
def rrf_negation(spark, sf_dir):
    texts = corpus.chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("id"), "content")
    negatives = corpus.text_queries(spark).select("query_id", F.array(F.lit(" Aning ")).alias("terms"))
    return retrieval.fuse_zero_based(_lists(spark, sf_dir), texts=texts, negatives=negatives).select("query_id", "id", "rank", rounded("score", 9).alias("score"))


@query
def negation_partition(spark, sf_dir):
    rows = retrieval.top(_fused(spark, sf_dir), retrieval.RESULTS).join(corpus.chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    return retrieval.negate(rows, F.array(F.lit("onble"))).select("query_id", "chunk_id", rounded("score", 9).alias("score"))


def _gated(spark, sf_dir):
    """One dense search serves both lists: its best ten stand alone, all are fused."""
    d = save(_dense(spark, sf_dir, retrieval.CANDIDATES), "dense")
    hybrid = save(retrieval.top(retrieval.fuse(d, _lexical(spark, sf_dir)), retrieval.RESULTS), "hybrid")
    return retrieval.gate(d.where(F.col("rank") <= retrieval.RESULTS), hybrid)


@query
def dense_gate_union(spark, sf_dir):
    return _gated(spark, sf_dir).select("query_id", "chunk_id", "match_source", rounded("score").alias("score"))


@query
def crag_tiers(spark, sf_dir):
    return retrieval.confidence_tier(_gated(spark, sf_dir).withColumn("rerank_score", F.lit(None).cast("double")))


@query
def rerank_overlap(spark, sf_dir):
    rows = retrieval.top(_fused(spark, sf_dir), retrieval.RESULTS).drop("rank").join(corpus.chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    rows = rows.join(F.broadcast(corpus.text_queries(spark).select("query_id", "query")), "query_id")
    return retrieval.rerank(rows, 5).select("query_id", "chunk_id", "rank", rounded("rerank_score").alias("rerank_score"))


@query
def litm_order(spark, sf_dir):
    return retrieval.middle_last(retrieval.top(_fused(spark, sf_dir), retrieval.RESULTS)).select("query_id", "chunk_id", "slot")


def _questions(spark, sf_dir, endings=QUESTIONS, name: str = "query") -> DataFrame:
    """(conv_id, turn, query): what is said in every turn, and one of the questions behind it."""
    ending = F.get(F.array(*(F.lit(t).cast("string") for t in endings)), F.col("turn") % len(endings))
    return corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", ending).alias(name))


@query
def router_hops(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", tx.graph_hops(F.col("query")).alias("hops"))


@query
def negation_parse(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", tx.clean_query(F.col("query")).alias("cleaned"), F.array_join(tx.negative_terms(F.col("query")), ",").alias("negatives"))


@query
def sanitize_queries(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", tx.sanitize_query(F.col("text")).alias("query"))


@query
def tenant_scope(spark, sf_dir):
    rows = corpus.scoped(corpus.chunks(spark, sf_dir), 1)
    return rows.groupBy("collection").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("chars"))


@query
def star_join(spark, sf_dir):
    chunks = corpus.chunks(spark, sf_dir).select("chunk_id", "collection", "tenant")
    vectors = corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("label"))
    return chunks.join(vectors, "chunk_id").groupBy("tenant", "collection").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))


@query
def coverage_counts(spark, sf_dir):
    chunks = corpus.chunks(spark, sf_dir).select("chunk_id", "collection")
    rows = chunks.join(corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")
    has = F.count_if(F.col("embedding").isNotNull())
    return rows.groupBy("collection").agg(F.count("*").alias("n"), has.alias("n_embedded"), (F.count("*") - has).alias("n_missing"))


@query
def graph_traverse(spark, sf_dir):
    roots = corpus.table(spark, sf_dir, "region").select(F.lit(0).alias("query_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("concept"))
    rows = graph.traverse(roots, corpus.edges(spark, sf_dir), TRADE_HOPS)
    return rows.select("concept", "depth", F.array_join("path", ">").alias("path"))


@query
def graph_lineage(spark, sf_dir):
    root = corpus.table(spark, sf_dir, "supplier").agg(F.min("s_suppkey").alias("s_suppkey")).select(F.lit(0).alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("concept"))
    return graph.lineage(root, corpus.edges(spark, sf_dir), 1)


@query
def graph_rrf(spark, sf_dir):
    fused = save(_fused(spark, sf_dir), "fused")
    scores = graph.graph_scores(fused, corpus.links(spark, sf_dir), corpus.edges(spark, sf_dir), 1)
    return _ranked(graph.graph_fuse(fused, scores, retrieval.RESULTS))


@query
def graph_bench_sum(spark, sf_dir):
    return _ranked(graph.graph_sum(save(_fused(spark, sf_dir), "fused"), corpus.links(spark, sf_dir), corpus.edges(spark, sf_dir), retrieval.RESULTS))


@query
def link_counts(spark, sf_dir):
    new = corpus.links(spark, sf_dir).withColumn("version", F.lit(1))
    rows = graph.ranked_links(new.unionByName(new.withColumns({"version": F.lit(2), "confidence": F.lit(0.9)}).where("confidence > 0")))
    return rows.groupBy("concept").agg(F.count("*").alias("n"), rounded(F.avg("confidence")).alias("confidence"))


@query
def neighbors_window(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("order"), "role")
    anchors = rows.where("role = 'system'").unionByName(rows.where("order = 3"))
    near = graph.neighbours(anchors.select("doc", "order").distinct(), rows)
    return near.select(F.col("doc").alias("conv_id"), F.col("anchor").alias("anchor"), F.col("order").alias("turn"), "role")


@query
def concept_ilike(spark, sf_dir):
    nations = corpus.table(spark, sf_dir, "nation").select("n_name")
    hit = nations.where(F.contains(F.lower("n_name"), F.lit("an")) | F.contains(F.lower("n_name"), F.lit("1")))
    context = F.concat(F.lit("### Concept: "), F.col("n_name"), F.lit(" (nation)\n"), F.lit("A nation."))
    return hit.orderBy("n_name").limit(4).select(context.alias("content"), F.lit(1.0).alias("score"), F.concat(F.lit("concept:"), F.col("n_name")).alias("source_url"))


@query
def title_mentions(spark, sf_dir):
    words = sorted({w for _, t in corpus.QUERIES for w in t.lower().split()} - {"not"})
    docs = corpus.table(spark, sf_dir, "documents").select(F.lower("text").alias("text"))
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("text"), F.lit(w)), F.lit(w)) for w in words)))
    return docs.select(F.explode(held).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def _catalogue(spark, sf_dir):
    """The first two words of every benchmark item, as names."""
    return corpus.table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("name"))


@query
def entity_mentions(spark, sf_dir):
    """How many documents mention each name of a catalogue."""
    found = concepts.mentions(corpus.chunks(spark, sf_dir).select("chunk_id", "content"), _catalogue(spark, sf_dir))
    return found.groupBy(F.lower("name").alias("entity")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_chunk"))


@query
def chunk_concepts(spark, sf_dir):
    """Links of every document to its source and language, and to the names of a catalogue that it mentions."""
    chunks = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.array_compact(F.array("source", "lang")).alias("hierarchy"), F.lit("corpus").alias("root"))
    rows = concepts.links(chunks, _catalogue(spark, sf_dir))
    return rows.groupBy(F.lower("concept").alias("concept"), "confidence").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("chunks"))


@query
def concept_uuids(spark, sf_dir):
    return corpus.edges(spark, sf_dir).select("src", "dst", concepts.concept_uuid(F.lit(1), F.col("src")).alias("src_id"), concepts.edge_uuid(F.lit(1), concepts.concept_uuid(F.lit(1), F.col("src")), concepts.concept_uuid(F.lit(1), F.col("dst")), F.col("relation")).alias("edge_id"))


@query
def hash_embedding(spark, sf_dir):
    """Signed hashed word counts of the documents, normalised; one row per filled dimension."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("words")
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    # A row is a document, unless rows share an id: these alone are summed across tasks.
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("shared_id"))
    shared = small(save(shared, "hash-shared"))
    same = F.col("doc_id").eqNullSafe(F.col("shared_id"))
    counted = lambda rows: rows.select("doc_id", words).mapInArrow(_hashed, f"doc_id {kind}, dim long, x double, squares double")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sums = counted(docs.join(shared, same, "left_semi")).groupBy("doc_id", "dim").agg(F.sum("x").alias("x"))
    sums = sums.withColumn("squares", F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id")))
    rows = counted(docs.join(shared, same, "left_anti")).unionByName(sums)
    return rows.where("x <> 0").select("doc_id", "dim", F.round(F.col("x") / F.sqrt("squares"), 8).alias("x")).where("x <> 0")


def _hashed(batches):
    """(doc_id, dim, x, squares) of batches of (doc_id, words): a batch's words are hashed once each."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            lists = part.column(1).fill_null([]) if part.column(1).null_count else part.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = pc.dictionary_encode(lists.flatten())
            digests = [hashlib.sha256(w.encode()).digest() for w in coded.dictionary.to_pylist()]
            dims = np.array([int.from_bytes(d[:4], "big") % 768 for d in digests], np.int64)
            signs = np.array([1.0 if d[4] % 2 else -1.0 for d in digests])
            at_word = coded.indices.to_numpy().astype(np.int64)
            keys = np.repeat(np.arange(len(sizes)), sizes) * 768 + dims[at_word]
            sums = np.bincount(keys, signs[at_word], len(sizes) * 768)
            squares = (sums.reshape(-1, 768) ** 2).sum(axis=1)
            filled = np.flatnonzero(sums)
            row, dim = np.divmod(filled, 768)
            yield pa.RecordBatch.from_arrays([pc.take(part.column(0), pa.array(row)), pa.array(dim), pa.array(sums[filled]), pa.array(squares[row])], ["doc_id", "dim", "x", "squares"])


@query
def chunk_simple(spark, sf_dir):
    """A chunk at each heading of the documents' markdown."""
    parts = F.posexplode(F.split(F.col("text"), "\n(?=## )")).alias("at", "content")
    rows = _markdown(spark, sf_dir).select("doc_id", parts).where("trim(content) <> ''")
    title = F.trim(F.regexp_extract("content", r"^#+ ([^\n]*)", 1))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#c"), F.lpad(order.cast("string"), 3, "0")).alias("chunk_id"), F.when(title == "", "Overview").otherwise(title).alias("section"), F.length(F.rtrim("content", F.lit(" \t\n\x0b\f\r"))).alias("chars"))


@query
def chunk_pack(spark, sf_dir):
    rows = sequential.chunk_documents(_markdown(spark, sf_dir))
    doc = F.sha2(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), 256)
    return rows.select("doc_id", "chunk_order", "token_count", tx.chunk_id(doc, F.col("chunk_order"), F.col("content")).alias("chunk_id"), tx.chunk_quality(F.col("content"), F.col("token_count")).alias("quality"))


@query
def chunk_ids_quality(spark, sf_dir):
    n = tx.rough_tokens(F.col("text"))
    rows = corpus.table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", n.alias("token_count"), tx.chunk_id(F.col("doc_id"), F.lit(0), F.col("text")).alias("chunk_id"), tx.chunk_quality(F.col("text"), n).alias("quality"), F.substring(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("::"), F.col("source")), 256), 1, 24).alias("short_id"))


@query
def parse_confidence(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", tx.extraction_confidence(F.col("text")).alias("confidence"))


@query
def html_to_markdown(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select("page_id", tx.html_to_markdown(F.col("html")).alias("markdown"))


@query
def toc_strip(spark, sf_dir):
    text = F.concat(F.lit(TOC + "\n"), F.col("text"))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", tx.strip_toc(text).alias("text"))


@query
def url_params_clean(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select("page_id", tx.clean_url(F.col("url")).alias("url"))


@query
def canonical_ids(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select("page_id", tx.canonical_id(F.concat(F.lit(" Document:"), F.col("url"))).alias("id"), tx.concept_name(F.concat(F.lit("## "), F.col("url"), F.lit(" **"))).alias("name"))


@query
def context_normalize(spark, sf_dir):
    plain = corpus.table(spark, sf_dir, "documents").select("doc_id", tx.distinct_sentences(F.coalesce("text", F.lit(""))).alias("plain"))
    return plain.select("doc_id", tx.cut_context(F.col("plain"), F.lit(retrieval.PROMPT_CHARS)).alias("context"))


@query
def context_compress(spark, sf_dir):
    rows = retrieval.top(_fused(spark, sf_dir), retrieval.RESULTS).join(corpus.chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    return retrieval.compress(rows.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("chunk_id").cast("string").alias("doc_id"), "content"))


@query
def concept_extract(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("title"), tx.html_to_markdown(F.col("html")).alias("text"))
    return sequential.extract_graphs(pages)


def _qrels(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_id"))
    quality = corpus.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    return rows.join(quality, "chunk_id", "left").select("query_id", "chunk_id", (1 + F.coalesce("quality", F.lit(0))).alias("rel"))


def _metrics(spark, sf_dir, ranked):
    return evaluate.judged(ranked, _qrels(spark, sf_dir))


@query
def ndcg_recall_mrr(spark, sf_dir):
    return _metrics(spark, sf_dir, _dense(spark, sf_dir, retrieval.RESULTS)).select("query_id", *(rounded(c).alias(c) for c in ("ndcg", "recall", "mrr")))


@query
def hit_at_k(spark, sf_dir):
    return evaluate.hit_rates(_metrics(spark, sf_dir, _dense(spark, sf_dir, retrieval.RESULTS))).select("k", rounded("hit_rate").alias("hit_rate"))


@query
def precision_recall_at5(spark, sf_dir):
    relevant = _qrels(spark, sf_dir).where("rel > 1").select("query_id", "chunk_id")
    rows = evaluate.at_k(_dense(spark, sf_dir, retrieval.RESULTS), relevant)
    return rows.select("query_id", *(rounded(c).alias(c) for c in ("recall_at_5", "precision_at_5", "mrr")))


@query
def metric_compare_pivot(spark, sf_dir):
    d = _metrics(spark, sf_dir, _dense(spark, sf_dir, retrieval.RESULTS)).withColumn("system", F.lit("dense"))
    h = _metrics(spark, sf_dir, retrieval.top(_fused(spark, sf_dir), retrieval.RESULTS)).withColumn("system", F.lit("hybrid"))
    rows = evaluate.compare(d.unionByName(h), ["ndcg", "recall", "mrr"], ["dense", "hybrid"])
    return rows.select("metric", rounded("dense").alias("dense"), rounded("hybrid").alias("hybrid"))


@query
def latency_percentiles(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events")
    pick = lambda p: rounded(F.percentile("value", p))
    return rows.groupBy("event_type").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"))


@query
def ingest_dedup(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("collection"), F.sha2("text", 256).alias("content_hash"))
    old = rows.where("collection = 'src0'").withColumn("collection", F.lit("src1"))
    return tables.ingest_new(old, rows).groupBy("collection").agg(F.count("*").alias("n_new"), F.min("doc_id").alias("first_doc"))


@query
def cascade_delete(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("collection"))
    parts = {"collections": docs.select(F.col("collection").alias("id")).distinct(), "documents": docs, "links": corpus.links(spark, sf_dir).select(F.col("chunk_id").alias("id"), F.col("chunk_id").alias("document"), "concept")}
    left = tables.delete_cascade(parts, {"documents": ("collections", "collection", "id"), "links": ("documents", "document", "id")}, "collections", spark.createDataFrame([("src0",), ("src3",)], "id string"))
    counts = [left[t].agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("collections", "documents", "links")]
    return counts[0].union(counts[1]).union(counts[2])


@query
def upsert_latest(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("version"))
    return tables.upsert(rows.where("event_type = 'click'"), rows.where("event_type <> 'click'"), ["user_id"], "version")


@query
def quota_daily(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("tenant"), "ts", F.floor("value").cast("long").alias("tokens"))
    return tables.quota(rows, 200).groupBy("tenant", "day").agg(F.sum("tokens").alias("tokens"), F.count_if("admitted").alias("n_admitted"), F.count("*").alias("n"))


@query
def rate_per_minute(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events")
    minutes = rows.groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))
    return minutes.select("user_id", "minute", "n", (F.col("n") > RATE_LIMIT).alias("limited"))


@query
def log_monthly(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events")
    return rows.groupBy(F.date_format("ts", "yyyy_MM").alias("partition")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query
def export_delta(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_hash"))
    new, _ = sinks.delta(rows, WATERMARK)
    return sinks.edge_replica(new).select("id", "sync_hash")


@query
def export_rows(spark, sf_dir):
    chunks = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_order"), F.col("text").alias("content"), F.col("source").alias("collection"), F.create_map(F.lit("source"), "source", F.lit("namespace"), "lang", F.lit("tags"), F.concat("lang", F.lit(",x"))).alias("metadata"))
    return tables.export_row(chunks).select("chunk_id", "source", "upstream_license", "document_id", "chunk_index", "content_hash", "namespace", "tags", "collection_name")


@query
def value_counts(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query
def citations(spark, sf_dir):
    rows = retrieval.top(_fused(spark, sf_dir), retrieval.RESULTS).join(corpus.chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    piece = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("content", 1, 6000))
    joined = rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x["p"]), "\n\n").alias("answer"))
    return joined.select("query_id", F.sha2("answer", 256).alias("answer_sha256"), tx.has_citation(F.col("answer")).alias("cites"), tx.abstains(F.col("answer")).alias("abstains"))


@query
def explain_rows(spark, sf_dir):
    rows = _gated(spark, sf_dir)
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max("match_source").alias("mode"), rounded(F.max("score")).alias("best"))


@query
def explain_detail(spark, sf_dir):
    """The diagnostics of every row of an answer."""
    sources = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("source_url"))
    rows = retrieval.explained(_gated(spark, sf_dir), sources)
    return rows.select("query_id", "place", "chunk_id", "document_id", "source_url", rounded("score").alias("score"), "match_source", "mode", "n_rows")


@query
def failure_summary(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "timed out").when(F.col("event_type") == "click", "eval_failed").when(F.col("user_id") % 2 == 0, F.col("props"))
    return service.failure_summary(corpus.table(spark, sf_dir, "events").select(text.alias("error")))


@query
def error_classes(spark, sf_dir):
    return _questions(spark, sf_dir, ERROR_TEXTS, "error").select("conv_id", "turn", tx.error_class(F.col("error")).alias("class"))


@query
def valid_rows(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"), F.max(F.trim(F.coalesce("text", F.lit(""))) != "").alias("has_text"), F.count(F.nullif("role", F.lit(""))).alias("n_ids"), F.count_distinct(F.nullif("role", F.lit(""))).alias("n_distinct"))
    return tables.valid_rows(rows).select("conv_id", "valid")


@query
def quality_gate(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("failed"), (F.col("value") >= 0).alias("evaluated"))
    return tables.quality_gate(rows).select(rounded("error_rate").alias("error_rate"), rounded("coverage").alias("coverage"), "verdict")


@query
def json_props(spark, sf_dir):
    raw = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return corpus.table(spark, sf_dir, "events").select("event_id", tx.repaired_json(raw).alias("json"))


@query
def vector_literals(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "embeddings")
    # Whole numbers, as engines write fractions differently.
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64))
    return rows.select("vec_id", F.size("embedding").alias("dim"), tx.vector_literal(whole).alias("literal"))


@query
def ext_tumbling(spark, sf_dir):
    rows = flows.tumbling(corpus.table(spark, sf_dir, "events"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", rounded("total", 4).alias("total"))


@query
def ext_sliding(spark, sf_dir):
    return flows.sliding(corpus.table(spark, sf_dir, "events"), "2 hours", "1 hour").select(F.col("w.start").alias("start"), "n")


@query
def ext_session(spark, sf_dir):
    return flows.sessions(corpus.table(spark, sf_dir, "events"), "6 hours").select("user_id", F.col("w.start").alias("start"), "n")


@query
def auth_lookup(spark, sf_dir):
    customer = corpus.table(spark, sf_dir, "customer")
    expires = F.when(F.col("c_custkey") % 3 == 0, F.lit(WATERMARK)).otherwise(F.lit(None).cast("timestamp"))
    keys = customer.select(F.sha2("c_name", 256).alias("key_hash"), F.col("c_mktsegment").alias("plan"), (F.col("c_acctbal") > 0).alias("is_active"), expires.alias("expires_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    return service.authenticate(customer.select(F.col("c_name").alias("token")), keys, WATERMARK).groupBy("plan").agg(F.count("*").alias("n"))


@query
def cache_hit_rate(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "user_id", "event_type")
    return service.cache_hits(rows, ["user_id", "event_type"]).groupBy("event_type").agg(F.count_if("hit").alias("n_hits"), F.count("*").alias("n"))


@query
def cache_keys(spark, sf_dir):
    return corpus.table(spark, sf_dir, "events").select("event_id", service.cache_key(F.col("user_id"), F.col("event_type"), F.col("props")).alias("key"))


def _jobs(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "processing").otherwise("complete")
    return service.job_states(corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("id"), status.alias("status")))


@query
def queue_states(spark, sf_dir):
    return _jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query
def queue_dequeue(spark, sf_dir):
    return service.dequeue(_jobs(spark, sf_dir), 10)


@query
def tombstones(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("version"), "event_type")
    gone = rows.where("event_type = 'error'").select("user_id", F.col("version").alias("deleted_version"))
    return service.without_tombstones(rows, gone, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query
def failure_report(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "timed out").when(F.col("event_type") == "click", F.concat(F.lit("HTTP "), F.col("user_id").cast("string"))).otherwise(F.col("props"))
    return service.failures(corpus.table(spark, sf_dir, "events").select(text.alias("error")))


@query
def slowest_samples(spark, sf_dir):
    return service.slowest(corpus.table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id")


@query
def order_scan(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("O")).alias("status"), F.col("o_orderkey").alias("id"))
    return rows.orderBy(F.asc_nulls_first("status"), "id")


@query
def rerank_gate(spark, sf_dir):
    asked = corpus.centroids(spark, sf_dir).select("query_id", (F.col("query_id") % 5 + 1).alias("depth"), F.lit(True).alias("asked"))
    return service.wants_rerank(asked, _gated(spark, sf_dir), 0.45)


@query
def hop_modes(spark, sf_dir):
    rows = _questions(spark, sf_dir).withColumns({"depth": F.col("turn") % 5 + 1, "hops": F.when(F.col("turn") % 4 == 0, 2)})
    return service.hop_mode(rows).select("conv_id", "turn", "mode", F.col("walk").alias("hops"))


@query
def fallback_answers(spark, sf_dir):
    rows = retrieval.top(_fused(spark, sf_dir), retrieval.RESULTS).join(corpus.chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    return service.fallback_answers(rows).select("query_id", F.sha2("answer", 256).alias("answer_sha256"), F.ceil(F.length("answer") / 500).alias("n_pieces"))


@query
def graph_simulated(spark, sf_dir):
    chunks = corpus.chunks(spark, sf_dir).select("chunk_id", "content", F.col("chunk_id").alias("place"))
    base, links = service.keyword_scores(chunks, corpus.QUERIES), corpus.links(spark, sf_dir)
    roots = retrieval.top(base, retrieval.GRAPH_SEEDS).join(links, "chunk_id").select("query_id", "concept").distinct()
    return _ranked(retrieval.top(service.simulated_graph_scores(base, graph.traverse(roots, corpus.edges(spark, sf_dir), 1), links), retrieval.RESULTS))


@query
def graph_second_ring(spark, sf_dir):
    """What two hops reach and neither the seeds nor one hop do."""
    roots = corpus.table(spark, sf_dir, "region").select(F.lit(0).alias("query_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("concept"))
    two, one = (graph.traverse(roots, corpus.edges(spark, sf_dir), n).select("concept") for n in (2, 1))
    return two.exceptAll(one).groupBy(F.substring("concept", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query
def benchmark_questions(spark, sf_dir):
    topics = [r.n_name for r in corpus.table(spark, sf_dir, "nation").select("n_name").orderBy("n_name").limit(25).collect()]
    return service.benchmark_questions(["What is {topic}?", "How does {topic} relate to trade?", "How to ship to {topic}"], topics, 120, spark)


@query
def grounding(spark, sf_dir):
    """Precision at five of what is cited under several names, against what is relevant."""
    rows = _dense(spark, sf_dir, retrieval.RESULTS).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("g"))
    name = lambda k: F.concat(F.lit("Chunk "), F.element_at("g", k)["chunk_id"].cast("string"))
    got = rows.select("query_id", service.harvested_ids([name(k) for k in range(1, 6)] + [F.lit(None).cast("string")]).alias("got"))
    cited = got.select("query_id", F.posexplode("got").alias("at", "id")).select("query_id", F.col("id").cast("long").alias("chunk_id"), (F.col("at") + 1).alias("rank"))
    rows = evaluate.at_k(cited, _qrels(spark, sf_dir).select("query_id", "chunk_id"))
    return rows.select("query_id", rounded("precision_at_5").alias("grounded"))


@query
def index_percentiles(spark, sf_dir):
    return evaluate.percentile_by_index(corpus.table(spark, sf_dir, "events"), "event_type", "value", 0.95).withColumnRenamed("value", "p95")


@query
def document_counts(spark, sf_dir):
    nation, supplier = corpus.table(spark, sf_dir, "nation"), corpus.table(spark, sf_dir, "supplier")
    return nation.join(supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n"))


@query
def chunk_paragraphs(spark, sf_dir):
    rows = _markdown(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("at", "part")).where("trim(part) <> ''")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("part")).alias("chars"))


@query
def filtered_export(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.nullif("o_orderstatus", F.lit("F")).alias("deleted"), "o_orderpriority")
    kept = tables.since(rows, "at", WATERMARK).where(F.col("deleted").isNull() & F.col("o_orderpriority").startswith("1"))
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("at").alias("watermark"))


@query
def chunk_sections(spark, sf_dir):
    rows = sequential.chunk_documents(_markdown(spark, sf_dir), how=sequential.sections)
    return rows.select("doc_id", "chunk_order", "token_count", F.sha2("content", 256).alias("content_hash"))


@query
def markdown_links(spark, sf_dir):
    text = F.concat(F.lit("see [page]("), "url", F.lit(") and [here](b?ref=1)"))
    return corpus.table(spark, sf_dir, "pages").select("page_id", tx.clean_links(text).alias("text"))


@query
def citation_sources(spark, sf_dir):
    """What an answer cites: the source's address, else the document, else that it is unknown."""
    rows = corpus.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("source_url"), F.when(F.col("page_id") % 6 != 0, F.col("page_id").cast("string")).alias("document_id"))
    return rows.select("page_id", service.cited(F.col("source_url"), F.col("document_id")).alias("source"))


@query
def depth_trim(spark, sf_dir):
    depths = corpus.centroids(spark, sf_dir).select("query_id", (F.col("query_id") % 5 + 1).alias("depth"))
    return retrieval.depth_trim(_gated(spark, sf_dir), depths).select("query_id", "chunk_id", "match_source")


@query
def rerank_negated(spark, sf_dir):
    rows = retrieval.top(_fused(spark, sf_dir), retrieval.RESULTS).drop("rank").join(corpus.chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    rows = rows.join(F.broadcast(corpus.text_queries(spark).select("query_id", "query")), "query_id")
    best = retrieval.rerank(rows, 7).select("query_id", "chunk_id", "content", "rerank_score", "score")
    return retrieval.negate_reranked(best, F.array(F.lit("onble"))).select("query_id", "chunk_id", "rank", rounded("rerank_score").alias("rerank_score"), rounded("score").alias("score"))


@query
def metric_coverage(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("system"), F.when(F.col("doc_id") % 7 != 0, F.col("quality").cast("double")).alias("quality"), F.when(F.col("toxic") == 0, F.lit(1.0)).alias("toxic"))
    rows = evaluate.coverage(rows, ["quality", "toxic"], ["even", "odd"])
    return rows.select("metric", rounded("even").alias("even"), rounded("odd").alias("odd"))


@query
def sql_dense_search(spark, sf_dir):
    """dense_top10 from SQL, by a table function called for each query."""
    functions.register(spark, sf_dir)
    corpus.centroids(spark, sf_dir).createOrReplaceTempView("corpus_asked")
    return _ranked(spark.sql("SELECT q.query_id, d.chunk_id, d.place AS rank, d.score FROM corpus_asked q, LATERAL corpus_dense_search(q.vector, 10) d"))


@query
def sql_neighbors(spark, sf_dir):
    """What stands beside the third turn of every conversation."""
    functions.register(spark, sf_dir)
    return spark.sql("SELECT a.conv_id, n.place AS turn, n.role FROM (SELECT DISTINCT conv_id, turn FROM corpus_turns WHERE turn = 3) a, LATERAL corpus_neighbor_chunks(a.conv_id, a.turn, 1) n")


@query
def sql_concepts(spark, sf_dir):
    """Concepts beside every region, and the chunks that speak of them."""
    functions.register(spark, sf_dir)
    rows = spark.sql("SELECT r.concept AS region, b.concept, l.confidence FROM (SELECT DISTINCT src AS concept FROM corpus_edges WHERE src LIKE 'r%') r, LATERAL corpus_concepts_beside(r.concept) b, LATERAL corpus_linked_chunks(b.concept) l")
    return rows.groupBy("region").agg(F.count_distinct("concept").alias("n_concepts"), F.count("*").alias("n_links"), rounded(F.avg("confidence")).alias("confidence"))


@query
def sql_counts(spark, sf_dir):
    functions.register(spark, sf_dir)
    return spark.sql("SELECT s.collection, corpus_collection_document_count(s.collection) AS n, corpus_embedding_dimension() AS dim FROM (SELECT DISTINCT collection FROM corpus_chunks WHERE collection IS NOT NULL) s")


@query
def raw_ingest(spark, sf_dir):
    """Documents as raw texts to take in, some for collections that have no proper id: how many are refused, and why."""
    collection = F.when(F.col("doc_id") % 7 == 0, F.col("source")).when(F.col("doc_id") % 7 == 1, concepts.name_uuid(F.col("source")))
    rows = readers.raw_texts(corpus.table(spark, sf_dir, "documents").select(F.col("text").alias("raw_text"), collection.alias("collection_id")))
    return rows.groupBy(F.coalesce("reason", F.lit("taken")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.length("raw_text")).alias("chars"))


@query
def middleware_chain(spark, sf_dir):
    """Documents with a list of contents before them, through two steps, the first of them applied once more."""
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(TOC + "\n"), F.col("text")).alias("text"))
    rows = middleware.applied(middleware.applied(rows, [middleware.CONTENTS, middleware.LINKS]), [middleware.CONTENTS])
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.size("trace").alias("n_steps"), middleware.digest().alias("digest"))


@query
def allowed_scan(spark, sf_dir):
    """Orders of one status and priority, by an allow-listed scan."""
    rows = scans.fetch(corpus.table(spark, sf_dir, "orders"), {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}, {"o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"}, ["o_orderkey", "o_custkey"])
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_order"))


def _new_folder(spark, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def _stream(spark, sf_dir, name: str, folder: str) -> DataFrame:
    """A table as a stream of files, which are laid in a new folder, as a stream reads folders only."""
    rows = corpus.table(spark, sf_dir, name)
    rows.write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


@query
def quota_stream(spark, sf_dir):
    """quota_daily from state: events stream in, the admitted ones are written, and the log is read back."""
    folder = _new_folder(spark, "quota")
    rows = _stream(spark, sf_dir, "events", folder).select(F.col("user_id").alias("tenant"), "event_id", "ts", F.floor("value").cast("long").alias("tokens"))
    state.run_once(state.admissions(rows, 200), f"{folder}/log", f"{folder}/checkpoint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("window_start") / 86_400_000_000).cast("int"))
    return spark.read.parquet(f"{folder}/log").groupBy("tenant", day.alias("day")).agg(F.sum("tokens").alias("tokens"), F.count_if("admitted").alias("n_admitted"), F.count("*").alias("n"))


@query
def rate_stream(spark, sf_dir):
    """Requests beyond two a user and minute, from state."""
    folder = _new_folder(spark, "rate")
    rows = _stream(spark, sf_dir, "events", folder).select(F.col("user_id").alias("tenant"), "event_id", "ts", F.lit(1).alias("tokens"))
    state.run_once(state.admissions(rows, 2, 60, 120), f"{folder}/log", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/log").groupBy(F.col("tenant").alias("user_id")).agg(F.count_if(~F.col("admitted")).alias("n_limited"), F.count("*").alias("n"))


def _actions(events: DataFrame) -> DataFrame:
    action = F.when(F.col("event_type") == "view", "queue").when(F.col("event_type") == "click", "dequeue").when(F.col("event_type") == "error", "fail").otherwise("complete")
    return events.select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), F.col("ts").alias("at"), action.alias("action"), F.col("props").alias("error"))


@query
def queue_outcomes(spark, sf_dir):
    return service.queue_outcomes(_actions(corpus.table(spark, sf_dir, "events")))


@query
def queue_stream(spark, sf_dir):
    """queue_outcomes from state: each job's last status in the stream of transitions."""
    folder = _new_folder(spark, "queue")
    state.run_once(state.transitions(_actions(_stream(spark, sf_dir, "events", folder))), f"{folder}/log", f"{folder}/checkpoint")
    when = F.when(F.col("moved"), F.struct("at", "id"))
    rows = spark.read.parquet(f"{folder}/log").groupBy("job").agg(F.max_by(F.struct("status", "error"), when).alias("x"))
    return rows.where("x.status is not null").select("job", "x.status", "x.error")


@query
def log_partitions(spark, sf_dir):
    """Events written as a log by month, those of the odd months' folders declared, and a span of two months read back."""
    events, folder = corpus.table(spark, sf_dir, "events"), _new_folder(spark, "log")
    span = events.agg(F.min("ts"), F.max("ts")).first()
    first = span[0].date().replace(day=1) if span[0] else datetime.date(2024, 1, 1)
    months = [f"{first.year + (first.month - 1 + k) // 12}_{(first.month - 1 + k) % 12 + 1:02}" for k in range(0, 24, 2)]
    sinks.write_log(events, folder, "ts", months)
    after = datetime.date(first.year + (first.month + 1) // 12, (first.month + 1) % 12 + 1, 1)
    return sinks.read_log(spark, folder, "ts", first, after).groupBy("month", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query
def published_snapshot(spark, sf_dir):
    """Documents published twice, the second time without a language; the first version read again."""
    folder, docs = _new_folder(spark, "release"), corpus.table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"))
    first = sinks.publish(docs, folder)
    sinks.publish(docs.drop("lang"), folder)
    return sinks.snapshot(spark, folder, first).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("n_texts"))


@query
def derived_columns(spark, sf_dir):
    """Documents inserted, then some of their texts and some of their languages updated: columns made from the text, and the time of the last write."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), "lang")
    derived = {"chunk_hash": ("content", F.sha2("content", 256)), "n_words": ("content", F.size(F.split("content", " ")))}
    rows = docs.select("*", F.lit(None).cast("string").alias("chunk_hash"), F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("int").alias("updated_at")).where(F.lit(False))
    texts = docs.where("doc_id % 5 = 0").select("doc_id", F.concat(F.lit("new "), "content").alias("content"))
    langs = docs.where("doc_id % 7 = 0").select("doc_id", F.concat("lang", F.lit("-x")).alias("lang"))
    for at, new in enumerate((docs, texts, langs), 1):
        rows = tables.written(rows, new, ["doc_id"], derived, "updated_at", F.lit(at))
    return rows.select("doc_id", "lang", "chunk_hash", "n_words", "updated_at")


def _package(text: str) -> bytes:
    """A package of one paragraph a line."""
    out, lines = io.BytesIO(), "".join(f"<w:p><w:r><w:t>{escape(x, {chr(13): '&#13;'})}</w:t></w:r></w:p>" for x in text.split("\n"))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>')
    return out.getvalue()


def _packages(batches):
    """(path, text, content) with packages of the texts as contents where there are none."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            made = [c.as_py() if c.is_valid else _package(t.as_py()) for t, c in zip(part.column(1), part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["path", "content"])


@query
def office_texts(spark, sf_dir):
    """Every document as a file of its own, as a package or as RTF in turn, parsed back."""
    text = F.coalesce("text", F.lit(""))
    # Signs that XML has no place for go into RTF.
    as_package = (F.col("doc_id") % 2 == 0) & ~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"([\\{}])", r"\\$1"), "\r", r"\\'0d"), "\n", "\\\\par\n")
    rtf = F.encode(F.concat(F.lit(r"{\rtf1\ansi\ansicpg65001 "), marked, F.lit("}")), "UTF-8")
    name = F.concat(F.col("doc_id").cast("string"), F.when(as_package, ".docx").otherwise(".rtf"))
    rows = corpus.table(spark, sf_dir, "documents").select(name.alias("path"), F.when(as_package, text).alias("text"), F.when(~as_package, rtf).alias("content"))
    good, _ = readers.parse(rows.mapInArrow(_packages, "path string, content binary"))
    return good.select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), "confidence", F.sha2("text", 256).alias("text_sha256"))


@query
def phased_job(spark, sf_dir):
    """Events through a job that fails for some at first, for some always: outcomes by the attempt they come from."""

    def work(rows, attempt):
        passing = F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 > attempt), "HTTP 429: rate limit")
        return rows.withColumn("error", F.coalesce(passing, F.when(F.col("event_id") % 7 == 0, "malformed answer")))

    items = corpus.table(spark, sf_dir, "events").select("event_id", "event_type")
    rows = phases.run(items, phases.Job(_new_folder(spark, "job"), "event_id", work, slices=4))
    return rows.groupBy("attempt", "error").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.build().items() if k in QUERIES}
