"""Batch jobs over items that may fail one by one, to be stopped anywhere and run again.

The items are written down first, by slices of their keys' hashes; then each slice is a unit of work whose outcomes are
written whole or not at all. A run skips the units that stand, so a job that died goes on where it was and ends with the
rows it would have had. Some slices are a trial: if too few of their items succeed, the rest is not begun. Items whose
error may pass are tried again, a bounded number of times, each time after all others had their turn.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What an error that may pass says; share of a trial, and number of its items, that must succeed.
PASSING = ["timeout", "429", "rate limit", "connection", "server error", "temporarily unavailable"]
SHARE, LEAST, RETRIES = 0.4, 2, 2


class Refused(Exception):
    """Too little of the trial succeeded."""


@dataclass(frozen=True)
class Job:
    """work: from items and the number of the attempt, from 0, to rows with `error`, null where all went well. A row comes
    from one item and keeps its key and whatever the next attempt reads."""

    folder: str
    key: str
    work: Callable[[DataFrame, int], DataFrame]
    slices: int = 8
    trial: int = 1
    share: float = SHARE
    least: int = LEAST
    retries: int = RETRIES

    def unit(self, attempt: int, part: int) -> str:
        return f"{self.folder}/outcomes/attempt={attempt}/slice={part}"


def may_pass(error: Column) -> Column:
    """Whether it is worth trying again; false without an error."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(t)) for t in PASSING))


def stands(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run(items: DataFrame, job: Job) -> DataFrame:
    """Each item's last outcome and the `attempt` it comes from. A run that goes on takes the items that were written
    down at first, not those it is given. Items of a null key share a slice; of items of one key each is tried.
    An item is read and written at most once an attempt and never shuffled after it was laid out."""
    spark = items.sparkSession
    laid = f"{job.folder}/items"
    if not stands(spark, laid):
        part = F.pmod(F.xxhash64(job.key), F.lit(job.slices))
        items.withColumn("__slice", part.cast("int")).write.mode("overwrite").partitionBy("__slice").parquet(laid)
    schema = items.schema
    trial = [outcomes(spark, job, schema, 0, part) for part in range(min(job.trial, job.slices))]
    if trial:
        tried = reduce(DataFrame.unionByName, trial).agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("good")).first()
        if tried["n"] and tried["good"] < max(job.least, math.ceil(job.share * tried["n"])):
            raise Refused(f"{tried['good']} of {tried['n']} items of the trial succeeded")
    done = []
    for attempt in range(job.retries + 1):
        rows = reduce(DataFrame.unionByName, [outcomes(spark, job, schema, attempt, part) for part in range(job.slices)])
        last = attempt == job.retries
        # What may pass has a later outcome, but for the last attempt's.
        done.append((rows if last else rows.where(~may_pass(F.col("error")))).withColumn("attempt", F.lit(attempt)))
    return reduce(DataFrame.unionByName, done)


def outcomes(spark: SparkSession, job: Job, schema, attempt: int, part: int) -> DataFrame:
    """A unit's outcomes, worked out unless they stand."""
    path = job.unit(attempt, part)
    if not stands(spark, path):
        if attempt == 0:
            # Only this slice's folder is listed and read; it is not there if no key falls into it.
            rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("__slice", T.IntegerType())])).parquet(f"{job.folder}/items").where(F.col("__slice") == part).drop("__slice")
        else:
            rows = spark.read.parquet(job.unit(attempt - 1, part)).where(may_pass(F.col("error"))).drop("error")
        job.work(rows, attempt).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
