"""Where results go: sharded Parquet, deltas behind a watermark, edge replicas, reports."""

from __future__ import annotations

import datetime
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_shards(rows: DataFrame, path: str, shard_rows: int = 10_000, mode: str = "overwrite") -> None:
    rows.where(F.trim(F.coalesce("content", F.lit(""))) != "").write.option("maxRecordsPerFile", shard_rows).mode(mode).parquet(path)


def delta(rows: DataFrame, watermark, column: str = "created_at") -> tuple[DataFrame, object]:
    """Rows beyond the watermark, and the watermark after them."""
    new = rows if watermark is None else rows.where(F.col(column) > F.lit(watermark))
    return new, new.agg(F.max(column)).first()[0] or watermark


def edge_replica(rows: DataFrame) -> DataFrame:
    """Rows (id, content_hash, ...) with the hash that tells a replica apart."""
    return rows.withColumn("sync_hash", F.sha2(F.concat_ws("|", F.col("id").cast("string"), "content_hash"), 256))


def append_upsert(batch: DataFrame, path: str, key: str, version: str) -> None:
    """For foreachBatch: the latest of each key of the batch, appended under its batch folder."""
    batch.groupBy(key).agg(F.max_by(F.struct(*(c for c in batch.columns if c != key)), version).alias("x")).select(key, "x.*").write.mode("append").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/json")


def answer_stream(rows: DataFrame, piece: int = 500):
    """Pieces of answers (query_id, answer) in order, without gathering them."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("answer"), F.lit(1)) - 1) / piece)), lambda i: F.substring("answer", (i * piece + 1).cast("int"), F.lit(piece)))
    for row in rows.select("query_id", F.posexplode(pieces).alias("at", "delta")).orderBy("query_id", "at").toLocalIterator():
        yield row.query_id, row.delta


#: The log partition of rows without a time or of a month that was not declared.
OTHERS = "default"


def _month(at: str, kind: T.DataType):
    """yyyy_MM in UTC, whatever the session's zone."""
    if isinstance(kind, T.TimestampType):
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(at) / 86_400).cast("int"))
    else:
        day = F.to_date(at)
    return F.date_format(day, "yyyy_MM")


def write_log(rows: DataFrame, path: str, at: str, months: list[str]) -> None:
    """Rows by month (UTC) of `at` in folders month=yyyy_MM, those of months that are not declared in month=default. Months that
    occur in rows are replaced, others stay; a busy month is dealt by time to several tasks."""
    month = F.when(_month(at, rows.schema[at].dataType).isin(months), _month(at, rows.schema[at].dataType)).otherwise(OTHERS)
    dealt = rows.withColumn("month", month).repartitionByRange("month", at).sortWithinPartitions("month", at)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_log(spark: SparkSession, path: str, at: str, first: datetime.date, after: datetime.date) -> DataFrame:
    """Rows of a log from day `first` on and before day `after` (UTC). Only the folders of these months, and the one of all others, are opened."""
    log = spark.read.parquet(path)
    count = (after.year - first.year) * 12 + after.month - first.month + 1
    months = [f"{first.year + (first.month - 1 + k) // 12}_{(first.month - 1 + k) % 12 + 1:02}" for k in range(count)]
    kind = log.schema[at].dataType
    edge = lambda d: F.timestamp_seconds(F.lit((d - datetime.date(1970, 1, 1)).days * 86_400)) if isinstance(kind, T.TimestampType) else F.lit(d.isoformat()).cast(kind)
    return log.where(F.col("month").isin([*months, OTHERS]) & (F.col(at) >= edge(first)) & (F.col(at) < edge(after)))


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions under root, oldest first."""
    place, files = _folder(spark, root)
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v[0-9]+", n))


def publish(rows: DataFrame, root: str) -> int:
    """Write rows as the next version under root. They are written beside it and named by one rename, so a version is there whole
    or not at all; of two publishers at once each gets its own number."""
    spark = rows.sparkSession
    staging = f"{root.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    place, files = _folder(spark, staging)
    try:
        rows.write.parquet(staging)
        while True:
            number = max(versions(spark, root), default=0) + 1
            target = _folder(spark, f"{root.rstrip('/')}/v{number}")[0]
            if not files.exists(target) and files.rename(place, target):
                return number
    except BaseException:
        files.delete(place, True)
        raise


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest if none is named."""
    known = versions(spark, root)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"{root} has versions {known}")
    return spark.read.parquet(f"{root.rstrip('/')}/v{known[-1] if version is None else version}")
