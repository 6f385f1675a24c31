"""Scans of stored tables by equality on allowed columns, for callers whose filters come from outside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fetch(rows: DataFrame, where: dict, allowed: set[str], columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Rows of a table whose columns equal the given values (None: are null). Columns, asked for or compared, must be allowed.
    Values are literals, never SQL; the filters and columns reach the scan of a file or database table."""
    columns = sorted(allowed & set(rows.columns)) if columns is None else columns
    refused = sorted({*where, *columns} - allowed) + sorted({*where, *columns} & allowed - set(rows.columns))
    if refused:
        raise ValueError(f"columns that are not allowed or not there: {', '.join(refused)}")
    tests = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in where.items()]
    found = rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows
    found = found.select(*columns)
    return found if most is None else found.limit(most)


def database(spark: SparkSession, url: str, table: str, tables: set[str], key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1) -> DataFrame:
    """An allowed database table, read in parallel by ranges of a numeric key if its bounds are given; fetch() pushes filters to it."""
    if table not in tables:
        raise ValueError(f"table {table} is not allowed")
    options = {"url": url, "dbtable": table}
    if key and bounds:
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options).load()
