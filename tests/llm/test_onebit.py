"""Neighbour search by one-bit codes against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmith.llm import onebit, queries


def brute(rows, k, asks):
    good = [(n, i, v) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, _, v in good), default=0)
    x = np.array([list(v) + [0.0] * (width - len(v)) for _, _, v in good]).reshape(len(good), width)
    out = []
    for at, (n, i, _) in enumerate(good):
        if asks(i):
            far = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
            scored = sorted((float(d), j) for d, (m, j, _) in zip(far, good) if m != n)[:k]
            out += [(i, r + 1, j, d) for r, (d, j) in enumerate(scored)]
    return sorted(out)


def searched(spark, rows, k=10, every=10, parts=3):
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, row int, score double").repartition(parts)
    return sorted(tuple(r) for r in onebit.search(table, F.col("vec_id") % every == 0, k).collect())


def recall(found, want):
    return len({r[0:3:2] for r in found} & {r[0:3:2] for r in want}) / len(want)


def vectors(n, width, seed=0, centres=1, off=0.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width)) * 3 * (centres > 1)
    return [(k, (rng.normal(size=width) + middle[k % centres] + off).tolist()) for k in range(n)]


@pytest.mark.parametrize("shape", [dict(n=600, width=64), dict(n=600, width=12, centres=8), dict(n=400, width=33, off=5.0)])
def test_recall_and_scores(spark, monkeypatch, shape):
    monkeypatch.setattr(onebit, "BLOCK", 100)
    rows = vectors(**shape)
    found, want = searched(spark, rows), brute(rows, 10, lambda i: i % 10 == 0)
    assert recall(found, want) >= 0.99 and len(found) == len(want)
    exact = {(q, v): s for q, _, v, s in brute(rows, len(rows), lambda i: i % 10 == 0)}
    assert all(exact[q, v] == s for q, _, v, s in found)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_given_table(spark, sf_dir):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = sorted(tuple(r) for r in queries.queries()["op13_neighbours"](spark, sf_dir).collect())
    want = brute(rows, 10, lambda i: i % 100 == 0)
    assert len(found) == len(want) and recall(found, want) >= 0.99


def test_copies_fill_no_bucket(spark):
    """A crowd of equal vectors: ties go to the smaller id, nothing is capped."""
    rows = [(k, [1.0, 2.0, -1.0]) for k in range(90)] + [(k + 90, v) for k, v in vectors(60, 3)]
    assert searched(spark, rows) == brute(rows, 10, lambda i: i % 10 == 0)


def test_odd_vectors(spark):
    rows = vectors(30, 4) + [(50, None), (60, []), (70, [1.0, None]), (80, [float("nan"), 1.0]), (90, [float("inf"), 0.0]), (100, [0.0] * 4), (110, [1.0]), (120, [2.0, -1.0, 0.5, 0.1, 0.7, 1.0]), (None, [9.0] * 4), (0, [0.1, 0.2, 0.3, 0.4]), (10, [1e200, 1.0, 0.0, 0.0]), (20, [5e-324, 0.0, 0.0, 0.0])]
    found, want = searched(spark, rows), brute(rows, 10, lambda i: i % 10 == 0)
    assert [r[:3] for r in found] == [r[:3] for r in want] and [r[3] for r in found] == pytest.approx([r[3] for r in want])
    assert searched(spark, []) == [] and searched(spark, [(0, [1.0])]) == []


def test_batches_of_queries_agree(spark, monkeypatch):
    rows = vectors(200, 8)
    whole = searched(spark, rows, every=2)
    monkeypatch.setattr(onebit, "BATCH_CELLS", 200)
    assert searched(spark, rows, every=2) == whole


def test_bounds_spare_most_vectors():
    """At 64 dimensions a query reads few vectors in full, and the bound fails as seldom as it says."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    x[1000:1100] = x[:100] + rng.normal(size=(100, 64)) * 0.2
    codes, length, correction = onebit.encoded(x, np.zeros(64))
    assert codes.shape == (4000, 64 * onebit.BITS_PER // 8)
    q_length, q_unit = onebit.turned(x[:100], np.zeros(64))
    bounds = onebit.lower_bounds(q_unit, q_length, onebit.signs(codes, 64 * onebit.BITS_PER), length, correction)
    true = ((x[:100, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    assert (bounds > true).mean() < 0.003
    best = onebit.Nearest(100, 10)
    block = (np.arange(4000), np.arange(4000), x, codes, length, correction)
    assert onebit.scan(np.arange(100), x[:100], q_length, q_unit, block, best) < 0.15 * 100 * 4000
