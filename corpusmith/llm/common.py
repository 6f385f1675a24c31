"""Shared plumbing: table readers, stable draws, checked broadcasts; scratch tables come from corpusmith.scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.scratch import drop, save, save_alone, saved

__all__ = ["crc32_of_id", "draw", "drop", "fresh", "save", "save_alone", "saved", "small", "table"]

#: XXH64 words are read as 53-bit fractions when a stable uniform draw is needed.
DRAW_BITS = 53


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that df has not, whatever the case: the given ones, with underscores put before where they are taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draw(*cols, seed: int):
    """A uniform value in [0, 1) that depends on the columns and the seed alone."""
    word = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(word, 64 - DRAW_BITS) / F.lit(float(1 << DRAW_BITS))


def crc32_of_id(col):
    """CRC-32 of an id written as text."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


#: Bytes of a side that may be broadcast, and what a row costs besides its values.
BROADCAST_BYTES, ROW_BYTES = 48_000_000, 32


def _bytes(field: T.StructField):
    """About how many bytes a value takes."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return 4 * F.octet_length(F.to_json(F.struct(col)))
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if a sum of its values' bytes proves it small; Spark joins it by shuffle otherwise."""
    each = sum((_bytes(f) for f in df.schema.fields), F.lit(ROW_BYTES))
    size = df.agg(F.sum(each.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df
