"""Sharding by sampled splitters, in DataFrame functions only.

Records are ordered by a key: a hash of the text (so equal texts stand side by
side), the id, and a row number that was written down once. A size-weighted
sample of keys gives quantile boundaries; records are range-partitioned by
them; ranges that turn out overfull are sampled again and subdivided. Within
each range a running sum of sizes, shifted by the sums of the ranges before it,
places each record on the line of all bytes, and a shard is an equal stretch of
that line, whose ends move to the nearer edge of a group of equal texts. So a
group is split only if it is larger than a shard by itself, shard sizes differ
by less than the record or group at either end, and no window is wider than a
range.

Defined results: a null text counts as empty; an id of any type will do, and
only orders equal texts; rows repeated in full are told apart by the row number alone, so each gets a slot of
its own; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.llm.common import draw, save

#: Rows wanted in a range; the least and most ranges to begin with; sampled keys for each range.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES, PER_RANGE = 100_000, 64, 65_536, 16
#: A range is overfull beyond so many times the size or rows wanted, and is subdivided so often at most.
OVERFULL, TURNS = 3, 8
#: Splitters are looked up under the top bits of their hash.
PREFIX_BITS = 12


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow records: id, size, text_crc32 and the sort key (h, d, q), written
    down so that a lost task cannot renumber them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        (F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) if whole else F.xxhash64(F.col(id_col).cast("string"))).alias("d"),
        F.monotonically_increasing_id().alias("q"),
    )
    return save(narrow, "shard-keys")


def _sample(rows: DataFrame, chance, seed: int) -> list[tuple]:
    picked = rows.where(draw("h", "d", "q", seed=seed) < chance).select("h", "d", "q", "size")
    return sorted((r.h, r.d, r.q, r.size) for r in picked.collect())


def _quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    """Keys that cut the sample into parts; each was drawn in proportion to its size, so counts stand for bytes."""
    return [sample[len(sample) * k // parts][:3] for k in range(1, parts)] if sample else []


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of numbers as a table that the JVM makes from a literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def with_ranges(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """rows with `rng`, the number of splitters at or below the key."""
    groups: dict[int, list[dict]] = {}
    for h, d, q in splitters:
        groups.setdefault(h >> (64 - PREFIX_BITS), []).append({"h": h, "d": d, "q": q})
    looked_up, below = [], 0
    for p in range(-(1 << (PREFIX_BITS - 1)), 1 << (PREFIX_BITS - 1)):
        here = groups.get(p, [])
        looked_up.append({"prefix": p, "below": below, "cuts": here})
        below += len(here)
    lookup = literal_table(rows.sparkSession, looked_up, "prefix:long,below:int,cuts:array<struct<h:long,d:long,q:long>>")
    key = F.struct("h", "d", "q")
    # The lookup has 2 ** PREFIX_BITS rows and the splitters, both bounded by this module's parameters.
    joined = rows.join(F.broadcast(lookup), F.shiftright("h", 64 - PREFIX_BITS) == F.col("prefix"))
    return joined.withColumn("rng", F.col("below") + F.size(F.filter("cuts", lambda c: c <= key))).drop("prefix", "below", "cuts")


def split(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Records with their range, and (range, rows, bytes) of each range in order."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(LEAST_RANGES, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    if not n:
        return rows.withColumn("rng", F.lit(0)), []
    cuts = sorted({*_quantiles(_sample(rows, F.col("size") * (parts * PER_RANGE / total), 1), parts)})
    for turn in range(2, TURNS + 3):
        ranged = with_ranges(rows, cuts)
        stats = sorted(tuple(r) for r in ranged.groupBy("rng").agg(F.count("*"), F.sum("size")).collect())
        load = {r: max(c * parts / n, b * parts / total) for r, c, b in stats if c > 1}
        full = {r: x for r, x in load.items() if x > OVERFULL}
        if not full or turn == TURNS + 2:
            break
        chances = literal_table(rows.sparkSession, [{"rng": r, "chance": full[r] * PER_RANGE / c} for r, c, _ in stats if r in full], "rng:int,chance:double")
        # One row for each overfull range, whose number the parameters bound.
        again = ranged.join(F.broadcast(chances), "rng")
        by_range: dict[int, list[tuple]] = {}
        for x in again.where(draw("h", "d", "q", seed=turn) < F.col("chance")).select("rng", "h", "d", "q").collect():
            by_range.setdefault(x.rng, []).append((x.h, x.d, x.q))
        cuts = sorted({*cuts, *(c for r, keys in by_range.items() for c in _quantiles(sorted(keys), int(full[r]) + 1))})
    return ranged, stats


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): one row per row of docs."""
    ranged, stats = split(keyed(docs, id_col, text_col))
    total = sum(b for _, _, b in stats) or 1
    offsets, before, ahead = [], 0, 0
    for rng, count, size in stats:
        offsets.append({"rng": rng, "before": before, "ahead": ahead})
        before, ahead = before + count, ahead + size
    bounds = literal_table(docs.sparkSession, offsets, "rng:int,before:long,ahead:long")
    order = Window.partitionBy("rng").orderBy("h", "d", "q")
    # One row for each range, whose number the parameters bound.
    placed = ranged.join(F.broadcast(bounds), "rng").select(
        F.col("id").alias(id_col), "size", "text_crc32", "h",
        (F.col("before") + F.row_number().over(order) - 1).alias("place"),
        (F.col("ahead") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
    )
    shard_of = lambda twice: F.least(F.lit(shards - 1), F.floor(twice * shards / (2.0 * total))).cast("int")
    placed = save(placed.withColumn("shard", shard_of(2 * F.col("start") + F.col("size"))), "shard-places")
    # Groups that a boundary falls into are fewer than the shards; each goes whole to where its middle is.
    groups = placed.groupBy("h").agg(F.min("shard").alias("low"), F.max("shard").alias("high"), F.sum("size").alias("bytes"), F.min("start").alias("start"))
    cut = groups.where((F.col("low") < F.col("high")) & (F.col("bytes") <= total / shards)).select("h", shard_of(2 * F.col("start") + F.col("bytes")).alias("to")).collect()
    shard = F.col("shard")
    for g in cut:
        shard = F.when(F.col("h") == g.h, g.to).otherwise(shard)
    placed = placed.withColumn("shard", shard.cast("int"))
    firsts = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    first = F.element_at(F.create_map(*(F.lit(x) for s in range(shards) for x in (s, firsts.get(s, 0)))), F.col("shard"))
    return placed.select(id_col, "size", "text_crc32", "shard", (F.col("place") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The records themselves under path/shard=k/; docs' ids must be unique."""
    where = assign(docs, shards, id_col, text_col).select(id_col, "shard", "slot")
    docs.join(where, id_col).write.partitionBy("shard").parquet(path)
