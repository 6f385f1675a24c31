"""An approximate index for cosine search: an inverted file of k-means cells.

Build. Directions (vectors of unit length) are clustered by MLlib's k-means on at most
SAMPLE rows, drawn by a hash of the id; every row is then put in the cell of
its nearest centre, and the table is written partitioned by cell. A cell that is larger
than ROWS_A_FILE goes to several files, so that no task writes a crowd alone.

Search. A query is asked in its `probes` nearest cells only. The folders of cells
that no query of a batch asks are pruned from the scan; within the others each task
scores a cell's rows against the queries that ask it, as one matrix product, and keeps the
best k (`retrieval.scan`). `probes_for` finds the fewest probes that reach a wanted recall on a
bounded sample of queries: vectors without clusters need many, clustered ones few.

Defined results: vectors that are null, empty, all zero or hold a null or a component that
is not finite take no part; all others are indexed. Scores are exact cosines of the
rows found, ties go to the smaller chunk_id. A row may find itself. An empty table gives
an empty index and no rows.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.operators import retrieval
from corpusmith.scratch import save, scratch_root

#: Rows that centres are fitted on; most cells; rows of a file.
SAMPLE, MOST_CELLS, ROWS_A_FILE = 65_536, 4096, 250_000
#: Queries that recall is tried on.
TRIED, SEED = 64, 42


@dataclass(frozen=True)
class CellIndex:
    """A folder of files by cell, and the cells' centres: one row of unit length for each."""

    path: str
    centres: np.ndarray
    id_type: str


def directions(vectors: DataFrame, key: str) -> DataFrame:
    """(key, unit): rows that have a direction, as unit vectors."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    wide = vectors.where(F.coalesce(sound, F.lit(False)) & F.exists("vector", lambda x: x != 0)).select(key, F.col("vector").cast("array<double>").alias("vector"))
    most = F.array_max(F.transform("vector", lambda x: F.abs(x)))  # divided by first, so that no square overflows
    even = wide.withColumn("vector", F.transform("vector", lambda x: x / most))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return even.withColumn("norm", norm).select(key, F.transform("vector", lambda x: x / F.col("norm")).alias("unit"))


def build(vectors: DataFrame, cells: int | None = None, path: str | None = None) -> CellIndex:
    """Index vectors (chunk_id, vector) in a new folder. cells: about the square root of the rows, if not given."""
    spark = vectors.sparkSession
    rows = save(directions(vectors, "chunk_id"), "cell-directions")
    n = rows.count()
    path, id_type = path or f"{scratch_root(spark)}/corpusmith/cells-{uuid.uuid4().hex}", rows.schema["chunk_id"].dataType.simpleString()
    k = max(1, min(cells or math.isqrt(n), MOST_CELLS, n))
    if not n:
        rows.withColumn("cell", F.lit(0)).write.partitionBy("cell").parquet(path)
        return CellIndex(path, np.zeros((0, 0)), id_type)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "chunk_id"), 11) / float(1 << 53)
    some = rows.where(drawn < SAMPLE / n).limit(2 * SAMPLE) if n > SAMPLE else rows
    width = rows.agg(F.max(F.size("unit"))).first()[0]
    padded = F.concat("unit", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("unit")))
    points = save(some.select(array_to_vector(padded).alias("features")), "cell-sample")
    # One cell needs no fit.
    fitted = KMeans(k=k, seed=SEED, maxIter=15).fit(points).clusterCenters() if k > 1 else [np.ones(width)]
    centres = np.nan_to_num(retrieval.units(np.array(fitted)))
    placed = rows.mapInArrow(_placer(centres), f"chunk_id {id_type}, unit array<double>, cell int")
    placed = save(placed, "cell-placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))  # at most MOST_CELLS rows
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("piece", F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("n") / ROWS_A_FILE)))
    dealt.repartition("cell", "piece").select("chunk_id", "unit", "cell").write.partitionBy("cell").parquet(path)
    return CellIndex(path, centres, id_type)


def _placer(centres: np.ndarray):
    def batches(it):
        for batch in it:
            if batch.num_rows:
                at = (retrieval.matrix(batch.column(1), centres.shape[1]) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], ["chunk_id", "unit", "cell"])

    return batches


def read(spark: SparkSession, index: CellIndex) -> DataFrame:
    return spark.read.schema(f"chunk_id {index.id_type}, unit array<double>, cell int").parquet(index.path)


def _prober(centres: np.ndarray, probes: int):
    def batches(it):
        for batch in it:
            if batch.num_rows:
                nearest = np.argsort(-(retrieval.matrix(batch.column(1), centres.shape[1]) @ centres.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(nearest.astype(np.int32)), pa.list_(pa.int32()))], ["query_id", "vector", "parts"])

    return batches


def search(index: CellIndex, queries: DataFrame, k: int = retrieval.RESULTS, probes: int = 8) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best of each query (query_id, vector) in its nearest cells."""
    rows = directions(queries, "query_id").withColumnRenamed("unit", "vector")
    query_type = rows.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, vector array<double>, parts array<int>"
    asked = save(rows.mapInArrow(_prober(index.centres, probes), schema) if len(index.centres) else rows.withColumn("parts", F.array().cast("array<int>")), "cell-queries")
    # As many as there are cells at most: the folders that the scan opens.
    cells = sorted(r[0] for r in asked.select(F.explode("parts")).distinct().collect())
    there = read(queries.sparkSession, index).where(F.col("cell").isin(cells))
    return retrieval.scan(there.select("chunk_id", F.col("unit").alias("vector"), F.col("cell").alias("part")), asked, k)


def probes_for(index: CellIndex, queries: DataFrame, recall: float = 0.95, k: int = retrieval.RESULTS) -> int:
    """The fewest probes by which at most TRIED of the queries find that share of their k nearest. One search of all cells
    tells: a neighbour is found as soon as its cell is probed, as none nearer can take its place."""
    some = save(queries.orderBy(F.xxhash64(F.lit(SEED), "query_id"), "query_id").limit(TRIED), "cell-tried")
    n = len(index.centres)
    if not n:
        return 1
    true = {(r.query_id, r.chunk_id) for r in search(index, some, k, n).collect()}
    if not true:
        return 1
    found = read(queries.sparkSession, index).where(F.col("chunk_id").isin({c for _, c in true})).select("chunk_id", "cell").collect()
    cells: dict = {}
    for r in found:
        cells.setdefault(r.chunk_id, []).append(r.cell)
    asked = directions(some, "query_id").collect()
    order = np.argsort(-(np.array([r.unit for r in asked]) @ index.centres.T), axis=1, kind="stable")
    turn = {r.query_id: np.argsort(o) for r, o in zip(asked, order)}
    # How many cells each neighbour needs; one without an id needs all.
    needed = np.sort([1 + min((turn[q][c] for c in cells.get(chunk, ())), default=n - 1) for q, chunk in true])
    return int(needed[max(0, math.ceil(recall * len(true)) - 1)])
