"""Line dedup by distinct-site spread.

Lines are hashed where they stand; each line hash gathers a HyperLogLog sketch of
the sites it stands on, merged by aggregation. Sketches well above the threshold
decide at once, those well below it too; lines within BAND of it get an exact
count of distinct sites. A line on at least `sites` sites is boilerplate: its
first occurrence (smallest id, then line number) stays, all others go. Counting
covers every line of every document; a line's text never leaves its document.

Unless it is given, the threshold is SHARE of all distinct sites, at least LEAST
and at most SITES. Lines that repeat on fewer sites stay, however often they do.

Defined results: lines end at a line feed; a carriage return before it belongs to
the line's end, so `x` with and without one are the same line; a null text stays
null; blank lines (nothing but white space) are never boilerplate and stay; a
null site counts as one site of its own; a line repeated within one document
counts once for spread, and all its copies but the first occurrence go; rows
repeated in full are treated alike, so each keeps what the other keeps; an empty
table gives no rows. Columns keep their names, extra ones pass through, except
that a column named as a count gives way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.common import fresh, save, small

#: Most and least sites from which a line is boilerplate, and the share of all sites between them.
SITES, LEAST, SHARE = 8, 3, 0.4
#: log2 of sketch registers; relative width of the band that is counted exactly.
REGISTERS, BAND = 9, 0.25


def _lines(text):
    return F.split(text, "\n")


def _site(col):
    return F.xxhash64(F.coalesce(col.cast("string"), F.lit("")), col.isNull())


def threshold(docs: DataFrame, site_col: str = "source") -> int:
    """Sites from which a line is boilerplate, by the number of sites there are."""
    n = docs.agg(F.countDistinct(_site(F.col(site_col)))).first()[0]
    return max(LEAST, min(SITES, -int(-n * SHARE // 1)))


def boilerplate(docs: DataFrame, sites: int | None = None, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The occurrences (id, whole, line, h) of all lines that are not blank, and
    the boilerplate (h, n_sites, first_id, first_line)."""
    sites = threshold(docs, site_col) if sites is None else sites
    hashes = F.transform(_lines(F.col(text_col)), lambda x: F.when(x.rlike(r"\S"), F.xxhash64(F.when(F.endswith(x, F.lit("\r")), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))))
    # What a row has but once is made before its lines are dealt out, not again for each of them.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("whole"), _site(F.col(site_col)).alias("site"), hashes.alias("hashes"))
    rows = save(rows.select("id", "whole", "site", F.posexplode("hashes").alias("line", "h")).where("h is not null"), "line-hashes")
    spread = rows.groupBy("h").agg(F.hll_sketch_agg("site", REGISTERS).alias("sketch"), F.min(F.struct("id", "line")).alias("first"))
    guess = F.hll_sketch_estimate("sketch")
    spread = save(spread.select("h", "first", guess.alias("guess")).where(F.col("guess") >= sites * (1 - BAND)), "line-spread")
    close = spread.where(F.col("guess") <= sites * (1 + BAND)).select("h")
    exact = rows.join(small(close), "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("exact"))
    found = spread.join(exact, "h", "left").select("h", F.coalesce("exact", "guess").alias("n_sites"), F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line"))
    return rows.drop("site"), save(found.where(F.col("n_sites") >= sites), "boilerplate")


def dedup(docs: DataFrame, sites: int | None = None, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs without repeated boilerplate lines, plus the lines each row had and has lost."""
    rows, found = boilerplate(docs, sites, id_col, text_col, site_col)
    extra = rows.join(small(found), "h").where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("line") == F.col("first_line"))))
    docs = docs.drop(*counts)
    same, whole, gone, split = fresh(docs, "__id", "__whole", "__gone", "__split")
    # A document's line numbers are no more than its own lines.
    marks = extra.groupBy(F.col("id").alias(same), F.col("whole").alias(whole)).agg(F.collect_set("line").alias(gone))
    on = F.col(id_col).eqNullSafe(F.col(same)) & (F.xxhash64(text_col) == F.col(whole))
    # Lines are a column, as an expression would be worked out again for each line that is taken.
    joined = docs.join(marks, on, "left").withColumn(split, _lines(F.col(text_col)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone)), lambda i: F.get(split, i))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    made = [F.coalesce(F.size(split), F.lit(0)).alias(counts[0]), F.coalesce(F.size(gone), F.lit(0)).alias(counts[1])]
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), *made)
