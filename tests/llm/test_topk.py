"""Exact top-k against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmith.llm import topk


def brute(rows, k, asks):
    good = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in good:
        if i is not None and asks(i):
            scored = sorted((-max(topk.LOW, min(topk.HIGH, sum(a * b for a, b in zip(q, d)))), j) for m, j, d in good if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def searched(spark, rows, k=20):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row int, score int").repartition(3)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(table, F.col("vec_id") % 5 == 0, k).collect())


def vectors(n, dims=8, seed=0):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, 0.3) for _ in range(dims)]) for k in range(n)]


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "QUERY_BATCH", 9)
    rows = vectors(150)
    assert searched(spark, rows) == brute(rows, 20, lambda i: i % 5 == 0)


def test_ties_and_few_rows(spark):
    rows = [(k, [0.5, 0.25]) for k in range(60)] + vectors(20, 2, 1)
    rows = [(k, v) for k, (_, v) in enumerate(rows)]
    assert searched(spark, rows) == brute(rows, 20, lambda i: i % 5 == 0)
    few = vectors(4, 3)
    assert searched(spark, few) == brute(few, 20, lambda i: i % 5 == 0) and len(searched(spark, few)) == 3


def test_odd_vectors(spark):
    rows = vectors(12, 4) + [(20, None), (25, []), (30, [1.0, None]), (35, [float("nan"), 1.0]), (40, [float("inf"), 0.0]), (45, [1.0]), (50, [2.0, -1.0, 0.5, 0.1, 0.7, 1.0]), (55, [0.0] * 4), (None, [9.0] * 4)]
    assert searched(spark, rows) == brute([(i, v) for i, v in rows if i is not None], 20, lambda i: i % 5 == 0)
    assert searched(spark, []) == []


def test_large_components(spark):
    rows = [(k, [1e6 * (k + 1), -3.0, 1e4]) for k in range(8)]
    assert searched(spark, rows) == brute(rows, 20, lambda i: i % 5 == 0)


def test_repeated_rows(spark):
    rows = vectors(10, 3) + [(5, [0.1, 0.2, 0.3])] * 2
    assert searched(spark, rows) == brute(rows, 20, lambda i: i % 5 == 0)


def test_bounds_hold_and_prune():
    import numpy as np

    rng = np.random.default_rng(0)
    d = np.floor(rng.normal(0, 9, (640, 16)) + np.repeat(np.arange(10), 64)[:, None] * 20)
    blocks = [(np.arange(a, a + 64), np.arange(a, a + 64), d[a : a + 64], d[a : a + 64].max(0), d[a : a + 64].min(0)) for a in range(0, 640, 64)]
    q = np.abs(np.floor(rng.normal(0, 9, (5, 16))))
    best, scored = topk.Best(5, 20), []
    original = topk.products
    topk.products = lambda a, b: (scored.append(len(b)), original(a, b))[1]
    try:
        topk.score_blocks(np.full(5, -1), np.arange(5), q, blocks, best)
    finally:
        topk.products = original
    want = np.sort(q @ d.T, axis=1)[:, ::-1][:, :20]
    assert (best.score == want).all() and len(scored) < 10
