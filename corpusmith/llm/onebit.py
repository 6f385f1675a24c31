"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index. A vector less the centre is turned by a random rotation into BITS_PER
times as many directions, and only the signs are kept, packed into bytes. Beside
them stand two scalars: the vector's length and the inner product of its unit
vector with its own code, which corrects the estimate. Every row is indexed; only
the centre is fitted on a sample, of about SAMPLE rows drawn by a hash.

Search. The inner product of a query with a vector is estimated from the bits
alone: that of the rotated query with the signs, divided by the correction. The
estimate is off by more than CERTAIN * sqrt((1 / correction^2 - 1) / (bits - 1))
in about one of 700 cases, which bounds the distance from below. A block's
vectors whose lower bound beats the query's kth distance are read in full
and get their exact distance; the rest are passed over. A vector can be missed only
where its bound fails.

Queries are a stated set, taken in batches of at most BATCH_CELLS components: a
batch of fixed size is sent to all tasks, each keeps the best k of its own rows,
and a ranked merge finishes. No bucket exists that a crowd of equal vectors could
fill.

Defined results: vectors that are null, all zero, without an id, or hold a null or
a component that is not finite take no part, as query or as candidate; a shorter
vector counts as padded with zeros; a row never finds itself, but others with its
id or its components do; ties go to the smaller vec_id; lengths beyond the range
of doubles are not estimated but measured. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.llm.common import draw, save
from corpusmith.llm.topk import matrix

#: Bits for each dimension; standard errors that a bound allows for; the rotation's seed.
BITS_PER, CERTAIN, SEED = 4, 3.0, 42
#: Rows that the centre is fitted on, about.
SAMPLE = 16_384
#: Components of the queries sent at once; vectors and queries of a block.
BATCH_CELLS, BLOCK, QUERY_STEP = 1 << 21, 4096, 512
#: What a sum in single precision may be off by, relatively.
SLACK = 1e-4

RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("query_row", "query_id", "vec_id")] + [T.StructField("score", T.DoubleType())])
INDEX = "row long, vec_id long, vector array<double>, code binary, length double, correction double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, vector) of the rows that take part."""
    whole = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.exists(vector_col, lambda x: x != 0)
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.coalesce(whole & sound, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


@functools.lru_cache(maxsize=2)
def rotation(width: int) -> np.ndarray:
    """bits x width: orthonormal columns in random directions."""
    bits = -(-BITS_PER * max(2, width) // 8) * 8
    turned, sign = np.linalg.qr(np.random.default_rng(SEED).normal(size=(bits, width)))
    return turned * np.sign(np.diag(sign))


def turned(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of x less the centre, and their unit vectors, rotated; a row at the centre has a unit vector of zeros."""
    x = x - centre
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((x * x).sum(axis=1))
        unit = np.where((length > 0)[:, None], x / np.where(length > 0, length, 1.0)[:, None], 0.0)
    return length, np.nan_to_num(unit, nan=0.0, posinf=0.0, neginf=0.0) @ rotation(x.shape[1]).T


def encoded(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths and corrections."""
    length, unit = turned(x, centre)
    return np.packbits(unit > 0, axis=1), length, np.abs(unit).sum(axis=1) / math.sqrt(unit.shape[1])


def signs(codes: np.ndarray, bits: int) -> np.ndarray:
    """Packed signs as rows of unit length."""
    return (np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(bits))


def lower_bounds(q_unit: np.ndarray, q_length: np.ndarray, coded: np.ndarray, length: np.ndarray, correction: np.ndarray) -> np.ndarray:
    """Squared distances of queries to vectors, from below, by bits alone. coded: signs(); one row for each query."""
    with np.errstate(all="ignore"):
        estimate = (q_unit.astype(np.float32) @ coded.T).astype(np.float64) / correction
        error = CERTAIN * np.sqrt(np.maximum(0.0, 1.0 / correction**2 - 1.0) / (coded.shape[1] - 1)) + SLACK
        cosine = np.minimum(1.0, estimate + error)
        found = q_length[:, None] ** 2 + length**2 - 2.0 * q_length[:, None] * length * cosine
        found -= SLACK * (q_length[:, None] ** 2 + length**2) * (cosine >= 1.0)
    # What cannot be estimated is measured.
    return np.where(np.isfinite(found), found, -np.inf)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(((x - q) ** 2).sum(axis=1))


class Nearest:
    """The k nearest (distance, smaller vec_id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.vec = k, [np.empty(0)] * queries, [np.empty(0, np.int64)] * queries

    def kth(self, q: int) -> float:
        return self.score[q][-1] if len(self.score[q]) >= self.k else np.inf

    def add(self, q: int, scores: np.ndarray, vecs: np.ndarray) -> None:
        s, v = np.concatenate([self.score[q], scores]), np.concatenate([self.vec[q], vecs])
        order = np.lexsort((v, s))[: self.k]
        self.score[q], self.vec[q] = s[order], v[order]


def scan(q_rows, q, q_length, q_unit, block, best: Nearest) -> int:
    """Bring one block (rows, vec_ids, vectors, codes, lengths, corrections) into best; how many were measured."""
    rows, vecs, x, codes, length, correction = block
    coded, measured = signs(codes, q_unit.shape[1]), 0
    for start in range(0, len(q), QUERY_STEP):
        bounds = lower_bounds(q_unit[start : start + QUERY_STEP], q_length[start : start + QUERY_STEP], coded, length, correction)
        # A query's likeliest vectors come first, so that the others meet its kth distance.
        most = min(len(rows), best.k + 1)
        likely = np.argpartition(bounds, most - 1, axis=1)[:, :most]
        for i, bound in enumerate(bounds):
            at, tried = start + i, np.zeros(len(rows), bool)
            for turn in (likely[i], None):
                pick = turn if turn is not None else np.flatnonzero(~tried)
                pick = pick[(bound[pick] <= best.kth(at) ** 2 * (1 + SLACK)) & (rows[pick] != q_rows[at])]
                if len(pick):
                    best.add(at, distances(x[pick], q[at]), vecs[pick])
                    measured += len(pick)
                if turn is not None:
                    tried[turn] = True
    return measured


def _columns(batch: pa.RecordBatch, width: int):
    rows, vecs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    return rows, vecs, matrix(batch.column(2), width)


def _indexer(centre: np.ndarray):
    def batches(it):
        for batch in it:
            if batch.num_rows:
                codes, length, correction = encoded(_columns(batch, len(centre))[2], centre)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(length), pa.array(correction)], ["row", "vec_id", "vector", "code", "length", "correction"])

    return batches


def centre_of(rows: DataFrame, n: int) -> np.ndarray:
    """The mean of about SAMPLE of n rows (row, vector), padded with zeros to the longest vector of all."""
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    drawn = rows.where(draw(F.col("row"), seed=SEED) < SAMPLE / max(1, n))
    means = drawn.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x") / float(SAMPLE)).alias("x"), F.count("*").alias("n"))
    out, most = np.zeros(width), drawn.count()
    for r in means.collect():
        out[r["at"]] = r.x * SAMPLE / max(1, most)
    return np.where(np.isfinite(out), out, 0.0)


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Every usable vector with its code, written down, and the centre."""
    rows = save(usable(vectors, id_col, vector_col), "onebit-vectors")
    centre = centre_of(rows, rows.count())
    return save(rows.mapInArrow(_indexer(centre), INDEX), "onebit-index"), centre


def search(vectors: DataFrame, queries, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score). queries: the condition on id_col that states the query set."""
    spark = vectors.sparkSession
    kept, centre = index(vectors, id_col, vector_col)
    asked = kept.select("row", F.col("vec_id").alias(id_col), "vector").where(queries)
    asked = save(asked.select("row", F.col(id_col).alias("vec_id"), "vector"), "onebit-queries")
    parts = max(1, math.ceil(asked.count() * max(1, len(centre)) / BATCH_CELLS))
    found = None
    for part in range(parts):
        # A hash deals the queries out; a batch is sent, answered, written down and taken back before the next.
        batch = asked.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part) if parts > 1 else asked
        sent = spark.sparkContext.broadcast(batch.toArrow())
        here = save(kept.mapInArrow(_searcher(sent, centre, k), RESULT), "onebit-part")
        sent.destroy()
        found = here if found is None else found.union(here)
    order = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(sent, centre: np.ndarray, k: int):
    def batches(it):
        asked = [_columns(b, len(centre)) for b in sent.value.to_batches() if b.num_rows]
        if not asked:
            return
        q_rows, q_ids, q = (np.concatenate([a[i] for a in asked]) for i in range(3))
        q_length, q_unit = turned(q, centre)
        best = Nearest(len(q), k)
        for batch in it:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                scan(q_rows, q, q_length, q_unit, (*_columns(part, len(centre)), codes, part.column(4).to_numpy(), part.column(5).to_numpy()), best)
        filled = [len(s) for s in best.score]
        out = [np.repeat(q_rows, filled), np.repeat(q_ids, filled), np.concatenate(best.vec), np.concatenate(best.score)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], RESULT.names)

    return batches
