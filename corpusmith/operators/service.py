"""What surrounds retrieval: keys, caches, queues, gates, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.functions import text as tx
from corpusmith.operators import tables

#: Seconds that a cached answer lives; fixed shares of the simulated graph search.
CACHE_TTL, SIM_DECAY, SIM_GAIN = 3600, 0.1, 0.35


def authenticate(presented: DataFrame, keys: DataFrame, now) -> DataFrame:
    """Presented tokens (token) with the key they belong to, if it is active, not expired and not revoked."""
    alive = F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))) & F.col("revoked_at").isNull()
    return presented.withColumn("key_hash", F.sha2("token", 256)).join(keys.where(alive), "key_hash")


def cache_hits(requests: DataFrame, keys: list[str], ttl: int = CACHE_TTL) -> DataFrame:
    """Requests (ts, id, keys...) with `hit`: an equal one was computed and kept less than ttl seconds before.
    A hit does not keep the answer any longer."""

    def step(until, values):
        at = values[0]
        return (until, (True,)) if at < until else (at + ttl * 1_000_000, (False,))

    rows = requests.withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp")))
    return tables.folded(rows, keys, ["__at", "id"], ["__at"], -(1 << 62), step, [T.StructField("hit", T.BooleanType())]).drop("__at")


def cache_key(*cols):
    """A digest of all options of a request, in order and with their places."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols)), 256)


def job_states(log: DataFrame) -> DataFrame:
    """The latest state of each job. log: (job, at, id, status)."""
    return log.groupBy("job").agg(F.max_by(F.struct("status", "at"), F.struct("at", "id")).alias("x")).select("job", "x.status", "x.at")


def dequeue(states: DataFrame, n: int) -> DataFrame:
    """The n oldest queued jobs."""
    return states.where("status = 'queued'").orderBy("at", "job").limit(n)


def queue_outcomes(log: DataFrame) -> DataFrame:
    """(job, status, error) after a log (job, id, at, action, error): queue makes a job, once; dequeue takes a queued one;
    complete and fail end any that is there, the last of them counts; what comes before the job is there, or has no time,
    does nothing."""
    when = F.struct("at", "id")
    made = log.where("action = 'queue' and at is not null").groupBy("job").agg(F.min(when).alias("made"))
    later = log.where("action <> 'queue'").join(made, "job", "right").where(F.col("action").isNull() | (when > F.col("made")))
    ended = F.max_by(F.struct("action", "error"), F.when(F.col("action").isin("complete", "fail"), when))
    rows = later.groupBy("job").agg(ended.alias("x"), F.count_if(F.col("action") == "dequeue").alias("taken"))
    status = F.when(F.col("x.action") == "complete", "complete").when(F.col("x.action") == "fail", "failed").when(F.col("taken") > 0, "processing").otherwise("queued")
    left = made.join(rows, "job", "left")
    return left.select("job", status.alias("status"), F.when(F.col("x.action") == "fail", F.col("x.error")).alias("error"))


def without_tombstones(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows (key, version) that no tombstone (key, deleted_version) of the same or a later version covers."""
    last = tombstones.groupBy(key).agg(F.max("deleted_version").alias("__gone"))
    return rows.join(last, key, "left").where(F.col("__gone").isNull() | (F.col("version") > F.col("__gone"))).drop("__gone")


def failures(rows: DataFrame) -> DataFrame:
    """(class, n) of rows (error)."""
    return rows.groupBy(tx.error_class(F.col("error")).alias("class")).agg(F.count("*").alias("n"))


def failure_summary(rows: DataFrame) -> DataFrame:
    """One row of counts over results (error, null where there was none): all, failed, timed out, and those whose evaluation failed."""
    kind = F.when(F.col("error").isNotNull(), tx.error_class(F.col("error")))
    return rows.select(kind.alias("kind")).agg(F.count("*").alias("n"), F.count("kind").alias("n_failed"), F.count_if(F.col("kind") == "api_timeout").alias("n_timeout"), F.count_if(F.col("kind") == "evaluator_parse_failure").alias("n_evaluator"))


def slowest(rows: DataFrame, column: str, key: str, n: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(column), key).limit(n)


def wants_rerank(queries: DataFrame, rows: DataFrame, enough: float = 0.8) -> DataFrame:
    """(query_id, rerank): at depth 5 always, from depth 3 on if it was asked for and no dense row is clear.
    queries: (query_id, depth, asked); rows: (query_id, match_source, score)."""
    clear = rows.where((F.col("match_source") == "dense") & (F.col("score") >= enough)).select("query_id").distinct().withColumn("clear", F.lit(True))
    joined = queries.join(clear, "query_id", "left")
    return joined.select("query_id", ((F.col("depth") == 5) | (F.col("asked") & (F.col("depth") >= 3) & F.col("clear").isNull())).alias("rerank"))


def hop_mode(queries: DataFrame) -> DataFrame:
    """queries (query, depth, hops) with the hops to walk and how they were chosen."""
    low = F.col("depth") <= 2
    hops = F.when(F.col("hops").isNotNull(), F.col("hops")).when(low, 0).otherwise(tx.graph_hops(F.col("query")))
    return queries.withColumns({"mode": F.when(F.col("hops").isNotNull(), "manual").when(low, "concept_direct").otherwise("auto"), "walk": hops})


def cited(source_url, document_id):
    return F.coalesce(F.nullif(source_url, F.lit("")), document_id.cast("string"), F.lit("unknown"))


def fallback_answers(rows: DataFrame) -> DataFrame:
    """(query_id, answer): the excerpts (query_id, rank, content) that are not blank, joined."""
    kept = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("rank", F.trim(F.coalesce("content", F.lit(""))).alias("t")))), lambda x: x["t"] != ""), lambda x: x["t"])
    joined = rows.groupBy("query_id").agg(F.array_join(kept, "\n\n").alias("answer"))
    return joined.withColumn("answer", F.when(F.col("answer") == "", "No matching knowledge was found.").otherwise(F.col("answer")))


def keyword_scores(chunks: DataFrame, queries: list[tuple[int, str]]) -> DataFrame:
    """(query_id, chunk_id, score): how many of a query's words a chunk (chunk_id, content, place from 0) holds anywhere
    in its text, less the further back it stands."""
    low = F.lower("content")
    found = [F.struct(F.lit(q).alias("query_id"), sum(F.contains(low, F.lit(w)).cast("int") for w in sorted(set(t.lower().split()))).alias("matches")) for q, t in queries if t.split()]
    rows = chunks.select("chunk_id", "place", F.explode(F.array(*found)).alias("x")).where("x.matches > 0")
    return rows.select("x.query_id", "chunk_id", (F.col("x.matches") / (1 + SIM_DECAY * F.col("place"))).alias("score"))


def simulated_graph_scores(base: DataFrame, reached: DataFrame, links: DataFrame) -> DataFrame:
    """Keyword scores (query_id, chunk_id, score) plus a share of each link to what is reached."""
    gains = reached.join(links, "concept").select("query_id", "chunk_id", (F.col("confidence") * SIM_GAIN / (1.0 + F.col("depth"))).alias("score"))
    return base.unionByName(gains).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))


def benchmark_questions(templates: list[str], topics: list[str], size: int, spark) -> DataFrame:
    """(id, query, kind) of a deterministic evaluation set: every template with topics in turn."""
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    i = F.col("id")
    return spark.range(size).select(i, F.replace(pick(templates, i), F.lit("{topic}"), pick(topics, F.floor(i / len(templates)))).alias("query"), pick(["fact", "relation", "procedure"], i).alias("kind"))


def harvested_ids(row_ids: list, canonical=tx.canonical_id):
    """Canonical ids found under several names, in order, nulls and blanks out."""
    return F.filter(F.transform(F.array(*row_ids), lambda v: F.when(v.isNotNull(), canonical(v))), lambda v: F.coalesce(v, F.lit("")) != "")


def store_atomically(tables: dict[str, DataFrame], target: str) -> None:
    """All tables or none: written beside the target, moved there by one rename."""
    spark = next(iter(tables.values())).sparkSession
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        for name, rows in tables.items():
            rows.write.parquet(f"{staging}/{name}")
        if fs.exists(path(target)) or not fs.rename(path(staging), path(target)):
            raise FileExistsError(target)
    except BaseException:
        fs.delete(path(staging), True)
        raise
