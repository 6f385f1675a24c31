"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last keep the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.deploy import ship
from corpusmith.llm import bpe, decontam, lines, near, quality
from corpusmith.llm.common import drop, save_alone, saved, table
from corpusmith.llm.queries import vocabulary


#: Bytes of an Arrow batch. A worker of the stages holds a batch and what it makes of it, the JVM beside it both ways' buffers.
BATCH_BYTES = "4m"


def ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    ready(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), quality.held_out("doc_id", 3, 1))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, but for their first occurrence."""
    ready(spark)
    kept = lines.dedup(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity of 0.8 or more) the one of the smallest id stays.

    Candidates come from SimHash fingerprints of these shingles by covering masks, sure to meet within near.REACH bits. At 0.8
    fingerprints differ by up to 11, for which such masks are 4,095 tables, so MinHash keys bring those beyond. The exact
    similarity of whole texts decides about both (corpusmith.llm.near). op2_simhash itself has radius 2."""
    ready(spark)
    return near.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ready(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they decode to the text they came from."""
    ready(spark)
    rows = bpe.encode(docs, vocabulary())
    return rows.select("doc_id", (F.octet_length("token_bytes") / 4).cast("long").alias("n_tokens"), F.sha2("token_bytes", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The classifier, SimHash and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, since = docs, saved()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            # What the stage wrote down on its way, and what it read, goes once its result stands.
            docs = save_alone(docs, f"pipeline-{name}", since)
            drop(before)
    return docs
