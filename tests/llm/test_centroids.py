"""Centroid clustering against whole-number arithmetic in Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from corpusmith.llm import centroids, queries


def brute(rows, k, rounds, width, scale=256, seed=2):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, hash)."""
    kept = [(i, [math.floor(x * scale) for x in v], v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v, x) for i, x, v in kept if i is not None)
    at = [x for _, _, x in named[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(at))
    if not at:
        return []
    for _ in range(rounds):
        groups = {}
        for _, x, _ in kept:
            groups.setdefault(near(x)[1], []).append(x)
        at = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(at)]
    held = lambda x: min(x, centroids.LONG_MOST)
    found = [(i, near(x)[1], held(near(x)[0])) for i, x, _ in kept]
    inertia = {c: sum(d for _, n, d in found if n == c) for _, c, _ in found}
    return sorted(((i, c, d, held(inertia[c]), held(sum(inertia.values())), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def clustered(spark, rows, k, rounds, width, element="double"):
    table = spark.createDataFrame([(i, v, 1, b"x") for i, v in rows], f"vec_id long, embedding array<{element}>, cluster int, part binary").repartition(3)
    return sorted((tuple(r) for r in centroids.described(*centroids.cluster(table, k, rounds, width=width)).collect()), key=repr)


def points(n, width, seed=0, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(i % 4, spread) for _ in range(width)]) for i in range(n)]


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 16)
    rows = points(200, 6)
    assert clustered(spark, rows, 7, 5, 6) == brute(rows, 7, 5, 6)


def test_given_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = queries.queries()["op12_centroids"](spark, sf_dir)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [f.dataType for f in found.schema.fields[2:5]] == [T.LongType()] * 3
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, 40, 5, 64)


def test_rows_that_take_no_part(spark):
    rows = points(30, 3) + [(40, None), (41, []), (42, [1.0]), (43, [1.0, None, 2.0]), (44, [1.0, float("nan"), 2.0]), (45, [float("inf"), 0.0, 0.0]), (46, [1.0] * 4), (None, [0.5, 0.5, 0.5])]
    assert clustered(spark, rows, 5, 3, 3) == brute(rows, 5, 3, 3)
    assert {r[0] for r in clustered(spark, rows, 5, 3, 3)} == {*range(30), None}


def test_ties_repeats_and_empty_clusters(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(20)] + [(3, [0.0, 9.0]), (3, [9.0, 0.0]), (3, [9.0, 0.0])]
    assert clustered(spark, rows, 9, 4, 2) == brute(rows, 9, 4, 2)


def test_few_and_no_rows(spark):
    assert clustered(spark, points(3, 2), 8, 2, 2) == brute(points(3, 2), 8, 2, 2)
    assert clustered(spark, [], 8, 2, 2) == [] and clustered(spark, [(None, [1.0, 2.0])], 8, 2, 2) == []


@pytest.mark.parametrize("size", [1e6, 1e9, 1e17, 1e30])
def test_beyond_doubles(spark, size):
    """Whole numbers that doubles do not hold are counted in Python's integers."""
    rows = [(i, [x * size for x in v]) for i, v in points(24, 3, 5)]
    assert clustered(spark, rows, 4, 3, 3) == brute(rows, 4, 3, 3)


def test_guard_switches_at_the_bound():
    x = np.array([[3.0, -4.0], [1e6, 2.0]])
    at, distance = centroids.nearest(x, [[0, 0], [10**6, 0]])
    assert at.tolist() == [0, 1] and distance.tolist() == [25, 4] and distance.dtype == np.int64
    far = np.array([[2.0**40 + 1, 0.0]])
    at, distance = centroids.nearest(far, [[2**40, 0], [2**40 + 2, 1]])
    assert at.tolist() == [0] and distance.tolist() == [1] and distance.dtype == object
    sums, counts = centroids.summed(np.full((3, 1), 2.0**52 + 1), np.zeros(3, np.int64), 2)
    assert sums.tolist() == [[3 * (2**52 + 1)], [0]] and counts.tolist() == [3, 0]
