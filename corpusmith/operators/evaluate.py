"""Retrieval metrics per query, and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per judged query: ndcg, recall and reciprocal rank at k. ranked: (query_id,
    chunk_id, rank from 1); qrels: (query_id, chunk_id, rel)."""
    gain = lambda c: (F.pow(F.lit(2.0), F.col(c)) - 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "chunk_id")
    best = qrels.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(gain("rel") / F.log2(F.col("place") + 1.0)).alias("ideal"))
    ideal = ideal.join(qrels.groupBy("query_id").agg(F.sum((F.col("rel") > 0).cast("int")).alias("relevant")), "query_id")
    hits = ranked.where(F.col("rank") <= k).join(qrels, ["query_id", "chunk_id"]).groupBy("query_id").agg(
        F.sum(gain("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum((F.col("rel") > 0).cast("int")).alias("found"), F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first")
    )
    rows = ideal.join(hits, "query_id", "left")
    ratio = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return rows.select(
        "query_id", ratio("dcg", "ideal").alias("ndcg"), ratio("found", "relevant").alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.col("first"),
    )


def hit_rates(metrics: DataFrame, cuts=(1, 3, 5, 10)) -> DataFrame:
    """(k, hit_rate): the share of queries whose first relevant row is at k or before."""
    k = F.explode(F.array(*map(F.lit, cuts))).alias("k")
    return metrics.select("first", k).groupBy("k").agg(F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)).alias("hit_rate"))


def at_five(rows: DataFrame, k: int = 5) -> DataFrame:
    """recall, precision at k over distinct ids and reciprocal rank over all; null without an expectation.
    rows: (query_id, expected array, got array)."""
    cut = F.array_distinct(F.slice("got", 1, k))
    common = F.size(F.array_intersect(F.array_distinct("expected"), cut))
    first = F.array_min(F.filter(F.transform("expected", lambda e: F.array_position("got", e)), lambda p: p > 0))
    has = F.size("expected") > 0
    return rows.select(
        "query_id", F.when(has, common / F.size(F.array_distinct("expected"))).alias("recall_at_5"),
        F.when(has, F.when(F.size(cut) > 0, common / F.size(cut)).otherwise(0.0)).alias("precision_at_5"), F.when(has, F.coalesce(1.0 / first, F.lit(0.0))).alias("mrr"),
    )


def compare(rows: DataFrame, metrics: list[str], systems: list[str]) -> DataFrame:
    """One row per metric, its mean per system. rows: (system, metrics...)."""
    long = rows.unpivot(["system"], metrics, "metric", "value")
    return long.groupBy("metric").pivot("system", systems).agg(F.avg("value"))


def coverage(rows: DataFrame, metrics: list[str], systems: list[str]) -> DataFrame:
    """One row per metric, the share of rows of each system that have a value. rows: (system, metrics...)."""
    long = rows.unpivot(["system"], metrics, "metric", "value")
    return long.groupBy("metric").pivot("system", systems).agg(F.avg(F.when(F.col("value").isNotNull() & ~F.isnan("value"), 1.0).otherwise(0.0)))


def at_k(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """The same from rows: ranked (query_id, chunk_id, rank from 1), relevant (query_id, chunk_id)."""
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    marked = ranked.select("query_id", "chunk_id", "rank").join(relevant.withColumn("hit", F.lit(True)), ["query_id", "chunk_id"], "left")
    near, hit = F.col("rank") <= k, F.col("hit").isNotNull()
    rows = marked.groupBy("query_id").agg(F.count_if(near).alias("cut"), F.count_if(near & hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first")).join(total, "query_id")
    return rows.select("query_id", (F.col("hits") / F.col("n")).alias("recall_at_5"), (F.col("hits") / F.col("cut")).alias("precision_at_5"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def percentile_by_index(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, value): the element at floor(n * share) of each key's sorted values. Equal
    values are counted first, so a key's window holds its distinct values only."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("__n"))
    all_ = Window.partitionBy(key)
    upto = F.sum("__n").over(all_.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("__n").over(all_)
    placed = counts.select(key, value, upto.alias("__upto"), F.least(n - 1, F.floor(n * F.lit(share))).alias("__at"))
    return placed.where(F.col("__upto") > F.col("__at")).groupBy(key).agg(F.min(value).alias(value))
