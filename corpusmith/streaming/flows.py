"""Structured Streaming flows: idempotent ingestion, event windows, quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str):
    """New files of documents to target, each (collection, text) once: a batch drops
    what target holds already, so a batch that runs again adds nothing."""

    def store(batch: DataFrame, _: int) -> None:
        fresh = batch.withColumn("content_hash", F.sha2("text", 256)).dropDuplicates(["source", "content_hash"])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(target).select("source", "content_hash"), ["source", "content_hash"], "left_anti")
        fresh.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def once(events: DataFrame, key: str, late: str) -> DataFrame:
    """Streaming rows, each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
