"""Late-arrival partition overwrite of a day-partitioned Parquet layout.

A layout keeps the latest-arrived row of each key and cuts each day, sorted by
time and key, into files of a fixed number of rows: day=D/file_no=F/, one data file
in each, with the table's own columns. Rows are ranked without gathering a
day: they are range-partitioned by (day, time, key), a row's place is that in its
own partition plus the day's counts in the partitions before. A file is written
whole by one task, which streams through it.

Late rows. A Bloom filter of the keys of kept late rows is laid over the scan of the
starting files, of which only the key is read; an exact semi-join takes out
false positives. The days so found and the days of the late winners are the days
that are rewritten: their starting rows, less the replaced ones (the filter
spares most rows the join), and the late winners. New files are written beside
the layout; each day is then swapped in by one rename. Files of other
days are not opened.

The filter has a fixed number of bits (FILTER_WORDS words of 64), built by
bit_or over its words and handed to the scan as a scalar subquery, so neither it
nor anything else that grows with the rows passes through the driver, a broadcast or
one task. It is never wrong about a late key; the more keys, the more rows it lets on
to the exact join (about 1 % at 400,000 keys), and the result does not depend on it.

Defined results: a null time is day -1; a null key is a key like any other; a null
arrival is older than all and counts as late, for it did not arrive before the
cutoff; of rows of one key that arrived at one time the largest stays, column by
column, nulls smallest; equal rows are one. A day whose rows all moved away has no
files left. No early or no late rows give the layout of the others. A table without
rows gives an empty layout and no rows. Extra columns are kept and come after.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.llm.common import crc32_of_id, drop, fresh, save
from corpusmith.scratch import scratch_root

#: Words of 64 bits of the Bloom filter, and bits that a key sets.
FILTER_WORDS, FILTER_BITS = 1 << 16, 4
DAY_MICROS = 86_400_000_000


def micros(col, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a time without a zone, read in UTC, or of an instant; whatever the session's zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    whole = F.unix_date(F.to_date(col)).cast("long") * 86400 + F.hour(col) * 3600 + F.minute(col) * 60
    return whole * 1_000_000 + (F.date_part(F.lit("SECOND"), col) * 1_000_000).cast("long")


def day_of(at) -> Column:
    """Whole days since 1970 of microseconds, -1 for null."""
    return F.coalesce(((at - F.pmod(at, F.lit(DAY_MICROS))) / DAY_MICROS).cast("long"), F.lit(-1).cast("long"))


@dataclass(frozen=True)
class Layout:
    """Where the files are, the table's columns, and the names of those that rule it; day and file are the
    partition columns, under names that the table has not."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    at: str
    arrived: str
    size: int
    day: str
    file: str

    def micros(self, column: str) -> Column:
        return micros(F.col(column), self.schema[column].dataType)

    def order(self) -> list[Column]:
        return [F.asc_nulls_first(self.at), F.asc_nulls_first(self.key)]

    def latest(self, rows: DataFrame) -> DataFrame:
        """The latest-arrived row of each key, with its day; of several the largest, column by column."""
        row = fresh(rows, "row")[0]
        values = F.struct(self.arrived, *(c for c in rows.columns if c not in (self.key, self.arrived)))
        kept = rows.groupBy(self.key).agg(F.max(values).alias(row))
        kept = kept.select(*(F.col(c) if c == self.key else F.col(row)[c].alias(c) for c in rows.columns))
        return kept.withColumn(self.day, day_of(self.micros(self.at)))

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (day, ...) with the number of their file in the day, `size` rows each."""
        part, place, of, on, first, n, before = fresh(rows, "part", "place", "of", "on", "first", "n", "before")
        dealt = rows.repartitionByRange(F.asc(self.day), *self.order()).sortWithinPartitions(F.asc(self.day), *self.order())
        # Written down: part and place hold for the partitions as they were dealt here.
        dealt = save(dealt.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(place)), "late-dealt")
        starts = dealt.groupBy(F.col(self.day).alias(on), F.col(part).alias(of)).agg(F.min(place).alias(first), F.count("*").alias(n))
        earlier = Window.partitionBy(on).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.select(on, of, first, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
        found = dealt.join(starts, (F.col(self.day) == F.col(on)) & (F.col(part) == F.col(of)))
        at = F.col(place) - F.col(first) + F.col(before)
        return found.withColumn(self.file, ((at - F.pmod(at, F.lit(self.size))) / self.size).cast("int")).drop(part, place, of, on, first, n, before)

    def write(self, rows: DataFrame, path: str) -> None:
        """The files of rows (day, ...), one row for each key, in a new folder."""
        files = self.placed(rows).repartition(self.day, self.file).sortWithinPartitions(self.day, self.file, *self.order())
        files.write.partitionBy(self.day, self.file).parquet(path)

    def read(self) -> DataFrame:
        """All rows with day and file."""
        parts = [T.StructField(self.day, T.LongType()), T.StructField(self.file, T.IntegerType())]
        return self.spark.read.schema(T.StructType([*self.schema.fields, *parts])).parquet(self.path)

    def files(self) -> DataFrame:
        """(day, file, path) of every data file there is, from a listing."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.path)
        number = lambda name: F.regexp_extract("path", f"/{name}=(-?[0-9]+)/", 1)
        return listed.select(number(self.day).cast("long").alias(self.day), number(self.file).cast("int").alias(self.file), "path")


def layout(rows: DataFrame, size: int, key: str = "sale_id", at: str = "sold_at", arrived: str = "arrived_at") -> Layout:
    """An empty layout for rows like these, in a new folder."""
    day, file = fresh(rows, "day", "file_no")
    return Layout(rows.sparkSession, f"{scratch_root(rows.sparkSession)}/late-{uuid.uuid4().hex}", rows.schema, key, at, arrived, size, day, file)


def _bits(key) -> list[Column]:
    """The places of a key's bits in the filter."""
    one, two = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
    return [F.pmod(F.shiftright(one, k * 14).bitwiseXOR(two), F.lit(FILTER_WORDS * 64)) for k in range(FILTER_BITS)]


def _bit(place) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def bloom(keys: DataFrame, key: str) -> DataFrame:
    """One row: words, the filter of the keys. Its size is fixed, so one task may put its words in order."""
    bits = keys.select(F.explode(F.array(*_bits(F.col(key)))).alias("at"))
    words = bits.select(F.shiftright("at", 6).alias("word"), _bit(F.col("at")).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    every = keys.sparkSession.range(FILTER_WORDS).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = words.union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return ordered.select(F.col("words.bits").alias("words"))


def might_hold(words, key) -> Column:
    """False only where the key is not in the filter."""
    return reduce(lambda a, b: a & b, (F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0 for p in _bits(key)))


def _join(left: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """A semi or anti join by a key that may be null, by shuffle: the keys grow with the rows."""
    there = fresh(left, "there")[0]
    return left.join(keys.select(F.col(key).alias(there)).hint("merge"), F.col(key).eqNullSafe(F.col(there)), how)


def merge(at: Layout, late: DataFrame) -> list[int]:
    """Bring late rows into a layout; the days that were rewritten."""
    start = at.read().drop(at.file)
    newest = save(at.latest(late), "late-newest")
    # A late row without an arrival is older than what stands there already.
    beaten = save(_join(start.select(at.key), newest.where(F.col(at.arrived).isNull()), at.key, "left_semi"), "late-beaten")
    won = save(_join(newest, beaten, at.key, "left_anti"), "late-won")
    words = save(bloom(won, at.key), "late-filter").scalar()
    maybe = might_hold(words, F.col(at.key))
    replaced = _join(start.where(maybe).select(at.key, at.day), won, at.key, "left_semi")
    # As many as the calendar has days.
    days = sorted(r[0] for r in replaced.select(at.day).union(won.select(at.day)).distinct().collect())
    old = start.where(F.col(at.day).isin(days))
    stay = old.where(~maybe).unionByName(_join(old.where(maybe), won, at.key, "left_anti"))
    beside = f"{scratch_root(at.spark)}/corpusmith/late-{uuid.uuid4().hex}"
    at.write(stay.unionByName(won), beside)
    swap(at, beside, days)
    for table in (newest, beaten, won):
        drop(table)
    return days


def swap(at: Layout, beside: str, days: list[int]) -> None:
    """Put the days' folders in beside in the place of the layout's; a day that beside has not goes. One rename for each day."""
    place = lambda *p: at.spark._jvm.org.apache.hadoop.fs.Path("/".join(p))
    files = place(at.path).getFileSystem(at.spark._jsc.hadoopConfiguration())
    for d in days:
        new, old = place(beside, f"{at.day}={d}"), place(at.path, f"{at.day}={d}")
        files.delete(old, True)
        if files.exists(new):
            files.rename(new, old)
    files.delete(place(beside), True)


def overwrite(rows: DataFrame, cutoff: datetime.datetime, size: int, key: str = "sale_id", at: str = "sold_at", arrived: str = "arrived_at") -> tuple[Layout, list[int]]:
    """Write the layout of rows that arrived before cutoff (UTC) in a new folder, then bring the others into it; the
    layout and the rewritten days."""
    made = layout(rows, size, key, at, arrived)
    limit = int((cutoff - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))
    early = F.coalesce(made.micros(arrived) < limit, F.lit(False))
    made.write(made.latest(rows.where(early)), made.path)
    return made, merge(made, rows.where(~early))


def with_copies(sales: DataFrame) -> DataFrame:
    """sales and the changed copies that arrive later: of rows with h % 3 = 0 (h: CRC-32 of the id) on every seventh day."""
    h = crc32_of_id(F.col("sale_id"))
    again = sales.where((h % 3 == 0) & (day_of(micros(F.col("sold_at"), sales.schema["sold_at"].dataType)) % 7 == 0))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    changed = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)}
    return sales.unionByName(again.withColumns({c: x.cast(sales.schema[c].dataType) for c, x in changed.items()}))


DIGEST = "day long, file_no int, n_rows long, cents long, rows_crc long, ids_sha256 string"


def _digests(it):
    """From rows (day, file_no, id, cents, crc), each file's together and in order: one row for each file. Ids stream through the hash."""
    at, sha, sums, done = None, None, None, []
    for batch in it:
        if not batch.num_rows:
            continue
        day, file, cents, crc = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
        ids = batch.column(2).to_pylist()
        edges = np.flatnonzero((np.diff(day) != 0) | (np.diff(file) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)]):
            if (day[a], file[a]) != at:
                if at is not None:
                    done.append((*at, *sums, sha.hexdigest()))
                at, sha, sums = (day[a], file[a]), hashlib.sha256(), [0, 0, 0]
            elif sums[0]:
                sha.update(b",")
            sha.update(",".join(ids[a:b]).encode())
            sums = [sums[0] + b - a, sums[1] + int(cents[a:b].sum()), sums[2] + int(crc[a:b].sum())]
    if at is not None:
        done.append((*at, *sums, sha.hexdigest()))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], [c.split()[0] for c in DIGEST.split(", ")])


def described(at: Layout, days: list[int]) -> DataFrame:
    """One row for each file of a layout of sales, read back: what it holds, where it is, and whether it is new."""
    rows = at.read()
    micro = lambda c: F.coalesce(at.micros(c).cast("string"), F.lit(""))
    name = F.coalesce(F.col("sale_id").cast("string"), F.lit(""))
    cents = F.coalesce(F.floor(F.lit(100.0) * F.col("total") + 0.5), F.lit(0)).cast("long")
    crc = F.crc32(F.encode(F.concat_ws(":", name, micro("sold_at"), micro("arrived_at")), "UTF-8"))
    digest = rows.select(F.col(at.day).alias("day"), F.col(at.file).alias("file_no"), name.alias("id"), cents.alias("cents"), crc.alias("crc"), F.col("_metadata.row_index").alias("place"))
    # A file's hash is one chain, so its ids meet in one task, in order, and stream through it.
    digest = digest.repartition("day", "file_no").sortWithinPartitions("day", "file_no", "place").drop("place").mapInArrow(_digests, DIGEST)
    files = at.files().select(F.col(at.day).alias("day"), F.col(at.file).alias("file_no"), "path")
    there = [] if files.isEmpty() else [c for c in at.spark.read.parquet(at.path).columns if c not in (at.day, at.file)]
    return digest.join(files, ["day", "file_no"]).withColumns({"columns": F.lit(",".join(there)), "rewritten": F.col("day").isin(days)})
