"""Exact top-k by integer inner product, block at a time.

Candidates are packed into document-range blocks, each with a forward index
(its vectors as one matrix) and, for each dimension, the largest and smallest
component. For a query, the sum over dimensions of the larger of q * max and
q * min bounds every score of a block from above. A query's blocks are scored
in falling order of that bound, until it falls below the query's kth score.

Queries are a stated set, taken in batches of at most QUERY_BATCH: each batch is
sent to all tasks, each task keeps the best k of its own blocks, and a ranked
merge finishes. A batch's size is fixed, so nothing that is sent grows.

Defined results: vectors that are null, empty, without an id, or hold a null or a
component that is not finite take no part, as query or as candidate; a shorter vector
counts as padded with zeros; a row never matches itself, but other rows with
its id do; ties go to the smaller vec_id; scores beyond 64 bits are held at the
ends of that range. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.llm.common import save

#: Vectors of a block; queries sent at once; queries scored at once in a task.
BLOCK, QUERY_BATCH, QUERY_STEP = 512, 32_768, 1024
#: Rows for each task: at least the first (few rows need few tasks), the second once there are many.
TASK_ROWS, TASK_ROWS_MOST = 4096, 262_144
EXACT32, EXACT64 = float(1 << 24), float(1 << 53)
LOW, HIGH = -(1 << 63), (1 << 63) - 1

RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("query_row", "query_id", "vec_id", "score")])


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, vec_id, codes): codes are floor(scale * component) as doubles."""
    whole = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    codes = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.where(whole & F.coalesce(sound, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), codes.alias("codes"))


def matrix(codes: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of codes as a matrix of at least width columns."""
    lengths = np.diff(codes.offsets.to_numpy())
    flat = codes.values.to_numpy(zero_copy_only=False)[codes.offsets[0].as_py() : codes.offsets[-1].as_py()]
    most = max(width, int(lengths.max(initial=0)))
    if (lengths == most).all():
        return flat.reshape(len(lengths), most)
    out = np.zeros((len(lengths), most))
    out[np.arange(most)[None, :] < lengths[:, None]] = flat
    return out


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows, in the narrowest type that holds them."""
    bound = np.abs(q).max(initial=0) * np.abs(d).max(initial=0) * max(1, q.shape[1])
    if bound < EXACT32:
        return (q.astype(np.float32) @ d.astype(np.float32).T).astype(np.int64)
    if bound < EXACT64:
        return (q @ d.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.array([[min(HIGH, max(LOW, x)) for x in r] for r in whole(q) @ whole(d).T], np.int64).reshape(len(q), len(d))


class Best:
    """The k best (score, smaller vec_id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), LOW, np.int64)
        self.vec = np.full((queries, k), HIGH, np.int64)
        self.filled = np.zeros(queries, np.int64)
        self.k = k

    def floor(self, at: np.ndarray) -> np.ndarray:
        """The kth score, or the least value while there are fewer."""
        return np.where(self.filled[at] >= self.k, self.score[at, -1], LOW)

    def add(self, at: np.ndarray, scores: np.ndarray, vecs: np.ndarray, own: np.ndarray) -> None:
        """Scores of queries `at` against vecs; own marks a query's own row."""
        kth, last = self.score[at, -1][:, None], self.vec[at, -1][:, None]
        full = (self.filled[at] >= self.k)[:, None]
        better = (~full | (scores > kth) | ((scores == kth) & (vecs[None, :] < last))) & ~own
        for i in np.flatnonzero(better.any(axis=1)):
            found = np.flatnonzero(better[i])
            q, have = at[i], self.filled[at[i]]
            s = np.concatenate([self.score[q, :have], scores[i, found]])
            v = np.concatenate([self.vec[q, :have], vecs[found]])
            if len(s) > 4 * self.k:  # only what reaches the kth value needs sorting
                reach = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, v = s[reach], v[reach]
            order = np.lexsort((v, -s))[: self.k]
            n = len(order)
            self.score[q, :n], self.vec[q, :n], self.filled[q] = s[order], v[order], n


def score_blocks(q_rows, q_ids, q, blocks, best: Best) -> None:
    """Best of all blocks, each query's blocks in falling order of their bounds."""
    for start in range(0, len(q), QUERY_STEP):
        step = np.arange(start, min(start + QUERY_STEP, len(q)))
        part = q[step]
        bounds = np.stack([np.maximum(part, 0) @ high + np.minimum(part, 0) @ low for _, _, _, high, low in blocks], axis=1)
        order = np.argsort(-bounds, axis=1, kind="stable")
        alive = np.arange(len(step))
        for turn in range(len(blocks)):
            turn_bounds = bounds[alive, order[alive, turn]]
            # Bounds are doubles; beyond their exact range they get the benefit of the doubt.
            slack = np.where(np.abs(turn_bounds) < EXACT64, 0, np.abs(turn_bounds) * 1e-9)
            alive = alive[turn_bounds + slack >= best.floor(step[alive])]
            if not len(alive):
                break
            for b in np.unique(order[alive, turn]):
                rows, vecs, d, _, _ = blocks[b]
                at = step[alive[order[alive, turn] == b]]
                own = q_rows[at][:, None] == rows[None, :]
                best.add(at, products(q[at], d), vecs, own)


def search(vectors: DataFrame, queries, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score). queries: the condition on id_col that states the query set."""
    spark = vectors.sparkSession
    kept = save(usable(vectors, id_col, vector_col, scale), "topk-vectors")
    n = kept.count()
    tasks = max(1, min(-(-n // TASK_ROWS), max(64, -(-n // TASK_ROWS_MOST))))
    asked = kept.withColumnRenamed("vec_id", id_col).where(queries).withColumnRenamed(id_col, "vec_id")
    asked = save(asked, "topk-queries")
    parts = max(1, math.ceil(asked.count() / QUERY_BATCH))
    found = None
    # Batches hold QUERY_BATCH queries on average; a hash deals them out. Each is sent, answered, written down
    # and taken back before the next one, so that neither the driver nor an executor holds two.
    for part in range(parts):
        batch = asked.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part) if parts > 1 else asked
        sent = spark.sparkContext.broadcast(batch.toArrow())
        here = save(kept.coalesce(tasks).mapInArrow(_scorer(sent, k), RESULT), "topk-part")
        sent.destroy()
        found = here if found is None else found.union(here)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _scorer(sent, k: int):
    def batches(it):
        asked = sent.value.combine_chunks()
        q_rows, q_ids = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
        codes = asked.column("codes").combine_chunks()
        q = matrix(codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes) if len(asked) else np.zeros((0, 0))
        best = Best(len(q), k)
        for batch in it:
            if not len(q) or not batch.num_rows:
                continue
            d = matrix(batch.column(2), q.shape[1])
            wide = np.pad(q, ((0, 0), (0, d.shape[1] - q.shape[1])))
            rows, vecs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            blocks = [(rows[a : a + BLOCK], vecs[a : a + BLOCK], d[a : a + BLOCK], d[a : a + BLOCK].max(axis=0), d[a : a + BLOCK].min(axis=0)) for a in range(0, len(d), BLOCK)]
            score_blocks(q_rows, q_ids, wide, blocks, best)
        for start in range(0, len(q), QUERY_STEP):
            filled = best.filled[start : start + QUERY_STEP]
            have = np.arange(k)[None, :] < filled[:, None]
            out = [np.repeat(x[start : start + QUERY_STEP], filled) for x in (q_rows, q_ids)]
            out += [x[start : start + QUERY_STEP][have] for x in (best.vec, best.score)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], RESULT.names)

    return batches
