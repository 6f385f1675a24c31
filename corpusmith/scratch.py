"""Tables written on the way: they cut lineage and stand in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share. Without one, a temporary folder will do
    only where driver and executors are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"corpusmith-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def save(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back.

    Lost executors cost nothing written so far, and the plan above starts from
    a scan again. The folder goes with drop(), or when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/corpusmith/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = _place(spark, path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._corpusmith_path = path
    _SAVED.append(path)
    return kept


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where their scan gives fewer tasks than that (a small table of few row groups); larger tables
    stay as they are read. For work on texts that costs more than moving them."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


#: Folders that save() wrote and that are still there, oldest first.
_SAVED: list[str] = []


def _place(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = _place(spark, path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _SAVED:
        _SAVED.remove(path)


def drop(df: DataFrame) -> None:
    """Delete a table that save() wrote and that nothing reads any more."""
    path = getattr(df, "_corpusmith_path", None)
    if path:
        _delete(df.sparkSession, path)


def save_alone(df: DataFrame, tag: str, since: int) -> DataFrame:
    """save(df), then delete all other tables saved since there were `since` of them: only df needed them."""
    kept = save(df, tag)
    for path in _SAVED[since:-1]:
        _delete(df.sparkSession, path)
    return kept


def saved() -> int:
    """How many tables are there."""
    return len(_SAVED)
