"""Registered queries: each operator over its whole table, and SQL twins."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.deploy import shipped
from corpusmith.llm import bpe, centroids, chat, decontam, hosts, late, lines, onebit, quality, shards, simhash, topk, toxicity
from corpusmith.llm.common import table

#: The rules that op6 is asked for, as (verdict, host and path).
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: The conversation that op7 adds.
ADDED_CONVERSATION, ADDED_TEXT = -7, r"\### Assistant: </turn> ok"

#: The arrival from which op11's rows are late, and the number that sets its rows a file.
LATE_FROM, LATE_FILES = datetime.datetime(2024, 4, 10), 700


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents"), vocabulary())
    return rows.select("doc_id", (F.octet_length("token_bytes") / 4).cast("long").alias("n_tokens"), F.sha2("token_bytes", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality.held_out("doc_id", 3, 1)).drop("key")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    doc = F.regexp_extract(hosts.parts(F.col("url"))[1], r"/([0-9]{1,18})", 1).try_cast("long")
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    outcomes = pages.select("page_id", doc.alias("doc_id")).join(bad.where("bad is not null"), "doc_id").select("page_id", (F.col("bad") == 1).alias("bad"))
    return hosts.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(ADDED_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    return chat.read_back(chat.format_turns(rows.union(added)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality.held_out("doc_id", 4, 2))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.assign(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "sales")
    made, days = late.overwrite(late.with_copies(sales), LATE_FROM, 1 + sales.count() // LATE_FILES)
    return late.described(made, days)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.described(*centroids.cluster(table(spark, sf_dir, "embeddings"), 40, 5))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def queries() -> dict:
    found = (op1_bpe, op2_simhash, op3_quality, op4_decontamination, op5_line_dedup, op6_url_filters, op7_chat, op8_toxicity, op9_sharding, op10_topk, op11_late_overwrite, op12_centroids, op13_neighbours)
    return {f.__name__: shipped(f) for f in found}


def oracle_sql() -> dict[str, str]:
    from corpusmith.llm.oracles import SQL

    return dict(SQL)
