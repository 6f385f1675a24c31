"""Centroid clustering over whole-number vectors, exact in every round.

Vectors are taken as integers, floor(scale * component). Distances come from
the expansion |x|^2 - 2 x.c + |c|^2, a block of vectors against all centroids as
one float64 matrix product. While width * (max |x| + max |c|)^2 stays below 2^53,
every term of it is a whole number that a double holds, so the result is
exact; a block beyond that bound is done in Python's integers instead.

Each task adds up its vectors by cluster and hands on one table of sums, which
RDD.treeAggregate combines; only k rows of sums and counts reach the driver,
however many vectors there are. A new centroid is floor(sum / count), so rounds
give the same centroids whatever the partitions or the order of rows.

Defined results: vectors take part that have exactly `width` components, none of
them null, NaN or infinite. The first centroids are the k vectors of the smallest
hash of their ids; rows without an id are clustered, but start no centroid; rows
that repeat an id are separate vectors, and the smaller vector comes first among
them. Fewer rows than k give fewer centroids, none gives no rows. Ties go to the
smaller number; a centroid without vectors stays where it is. Distances and
inertias beyond 64 bits are held at the end of that range. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.llm.common import save

#: Vectors of a block; doubles hold whole numbers below EXACT.
BLOCK, EXACT = 8192, 1 << 53
LONG_MOST = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where((F.size(vector_col) == width) & F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def whole(x: float, scale: int) -> int:
    """floor(scale * x) whatever the size of x."""
    return int(x) * scale if abs(x) >= EXACT else math.floor(x * scale)


def coded(vectors: np.ndarray, scale: int) -> np.ndarray:
    """Whole numbers as doubles where that is exact, as Python's integers otherwise."""
    if np.abs(vectors).max(initial=0) * scale < EXACT:
        return np.floor(vectors * scale)
    return np.array([[whole(x, scale) for x in row] for row in vectors.tolist()], object)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid's number of each row and the squared distance, exact; the smaller number among equals.
    Rows of doubles that hold whole numbers, or of Python's integers."""
    most = max((abs(v) for c in centroids for v in c), default=0)
    if x.dtype != object:
        bound = x.shape[1] * (int(np.abs(x).max(initial=0)) + most) ** 2
        if bound < EXACT:
            c = np.array(centroids, np.float64)
            found = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
            at = found.argmin(axis=1)
            return at, found[np.arange(len(x)), at].astype(np.int64)
        x = np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    found = np.array([[sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids] for row in x], object).reshape(len(x), len(centroids))
    at = np.array([min(range(len(row)), key=row.__getitem__) for row in found], np.int64)
    return at, np.array([row[k] for row, k in zip(found, at)], object)


def summed(x: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums by cluster, in Python's integers, and counts."""
    counts = np.bincount(at, minlength=k)
    if x.dtype != object and len(x) * np.abs(x).max(initial=0) < EXACT:
        member = np.zeros((k, len(x)))
        member[at, np.arange(len(x))] = 1.0
        return (member @ x).astype(np.int64).astype(object), counts
    sums = np.zeros((k, x.shape[1]), object)
    for row, c in zip(x, at):
        sums[c] += np.array([int(v) for v in row], object)
    return sums, counts


def blocks(rows, width: int, scale: int):
    """(rows of the batch, their codes), at most BLOCK at a time."""
    for batch in rows:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part, coded(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)


def _sums(centroids: list[list[int]], width: int, scale: int):
    """For each task one row: the pickled sums and counts of its vectors."""
    import pickle

    def batches(it):
        sums, counts = np.zeros((len(centroids), width), object), np.zeros(len(centroids), np.int64)
        for _, x in blocks(it, width, scale):
            s, n = summed(x, nearest(x, centroids)[0], len(centroids))
            sums, counts = sums + s, counts + n
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((sums, counts))], pa.binary())], ["part"])

    return batches


def _add(a, b):
    return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])


def moved(vectors: DataFrame, centroids: list[list[int]], width: int, scale: int) -> list[list[int]]:
    """The centroids after one round over vectors (vec_id, vector)."""
    import pickle

    parts = vectors.mapInArrow(_sums(centroids, width, scale), "part binary").rdd
    total = parts.treeAggregate(None, lambda a, row: _add(a, pickle.loads(bytes(row.part))), _add)
    if total is None:
        return centroids
    return [[int(s) // int(n) for s in row] if n else old for row, n, old in zip(total[0], total[1], centroids)]


def _assigned(centroids: list[list[int]], width: int, scale: int):
    def batches(it):
        for part, x in blocks(it, width, scale):
            at, distance = nearest(x, centroids)
            if distance.dtype == object:
                distance = np.array([min(int(d), LONG_MOST) for d in distance], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return batches


def cluster(vectors: DataFrame, k: int, rounds: int, seed: int = 2, width: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """Assigned rows (vec_id, cluster, distance), written down, and the final centroids."""
    kept = save(usable(vectors, id_col, vector_col, width), "centroid-vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").orderBy(name, "vector").limit(k).collect()
    centroids = [[whole(x, scale) for x in r.vector] for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids, width, scale)
    if not centroids:
        kept = kept.limit(0)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    return save(kept.mapInArrow(_assigned(centroids, width, scale), f"vec_id {id_type}, cluster int, distance long"), "centroid-rows"), centroids


def centroid_hash(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def described(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Assigned rows with their cluster's inertia, the inertia of all, and the hash of their centroid."""
    sums = {r.cluster: r.total for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    overall = min(int(sum(sums.values())), LONG_MOST)
    # One row for each centroid: as many as were asked for, whatever the vectors.
    about = [(c, int(min(sums.get(c, 0), LONG_MOST)), overall, centroid_hash(x)) for c, x in enumerate(centroids)]
    about = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
