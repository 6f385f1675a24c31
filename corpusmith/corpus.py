"""The retrieval model's relations as views of the stored tables.

documents become one chunk each (collection = source, tenant = source number
modulo 4), vectors come from embeddings by id, quality from labels. Concepts and
edges form the trade graph region -> nation -> customer / supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stated query set: (query_id, text). Its vector is the centroid of the label of the same number.
QUERIES = [(0, "thanedble onble"), (1, "ontion antion"), (2, "retion aning"), (3, "reing heble"), (4, "onble retion heble"), (5, "antion aning"), (6, "ontion reing"), (7, "thanedble heble NOT aning")]
TENANTS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, collection, tenant, content, age_days: only what a plan selects is read."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("collection"), tenant_of(F.col("source")).alias("tenant"),
        F.col("text").alias("content"), (F.col("doc_id") % 365).alias("age_days"),
    )


def tenant_of(collection):
    return (F.substring(collection, 4, 10).cast("int") % TENANTS).alias("tenant")


def scoped(rows: DataFrame, tenant: int | None, collection: str | None = None) -> DataFrame:
    """Rows of one tenant; no tenant means no rows."""
    if tenant is None:
        return rows.where(F.lit(False))
    rows = rows.where(F.col("tenant") == tenant)
    return rows if collection is None else rows.where(F.col("collection") == collection)


def text_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, t, q % TENANTS) for q, t in QUERIES], "query_id int, query string, tenant int")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, vector: one row for each label."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("xs"))
    return ordered.select(F.col("label").alias("query_id"), F.col("xs.x").alias("vector"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, relation; suppliers point back to their nation, so there are cycles."""
    def named(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    parts = [
        nation.select(named("r", "n_regionkey").alias("src"), named("n", "n_nationkey").alias("dst"), F.lit("contains").alias("relation")),
        customer.select(named("n", "c_nationkey"), named("c", "c_custkey"), F.lit("contains")),
        supplier.select(named("n", "s_nationkey"), named("s", "s_suppkey"), F.lit("contains")),
        supplier.select(named("s", "s_suppkey"), named("n", "s_nationkey"), F.lit("located_in")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, concept, confidence: each chunk speaks of one nation."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(d.alias("chunk_id"), F.concat(F.lit("n"), (d % 25).cast("string")).alias("concept"), (F.lit(0.5) + (d % 5) / 10).alias("confidence"))
