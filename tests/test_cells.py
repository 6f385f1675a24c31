"""The index of k-means cells against exact search."""

import re

import numpy as np
import pytest

from corpusmith.operators import cells, retrieval
from corpusmith.plans import catalog


def frame(spark, x, name="chunk_id", at=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if at is None else at, x)], f"{name} long, vector array<double>")


def clustered(n=600, width=16, groups=12, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, width))[rng.integers(0, groups, n)] * 4 + rng.normal(size=(n, width))


def pairs(rows):
    return {(r.query_id, r.chunk_id) for r in rows.collect()}


@pytest.fixture(scope="module")
def index(spark):
    return cells.build(frame(spark, clustered()))


def test_every_row_has_a_cell(spark, index):
    rows = cells.read(spark, index)
    assert sorted(r.chunk_id for r in rows.collect()) == list(range(600))
    assert len(index.centres) == 24 and rows.select("cell").distinct().count() > 12


def test_recall_on_clusters_with_few_probes(spark, index):
    asked = frame(spark, clustered()[::10], "query_id")
    exact = pairs(retrieval.dense(frame(spark, clustered()), asked))
    found = cells.search(index, asked, probes=4)
    assert len(pairs(found) & exact) >= 0.9 * len(exact)
    held = {(r.query_id, r.chunk_id): r.score for r in retrieval.dense(frame(spark, clustered()), asked, 600).collect()}
    assert all(abs(held[r.query_id, r.chunk_id] - r.score) < 1e-12 for r in found.collect())
    assert pairs(cells.search(index, asked, probes=24)) == exact


def test_probes_grow_with_the_wanted_recall(spark, index):
    asked = frame(spark, clustered()[::10], "query_id")
    few, many = cells.probes_for(index, asked, 0.5), cells.probes_for(index, asked, 1.0)
    assert 1 <= few <= many <= 24 and few < 12


def test_unasked_folders_are_pruned(spark, index, capsys):
    asked = frame(spark, clustered()[:1], "query_id")
    found = cells.search(index, asked, probes=2)
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[cell#\d+ IN \(\d+,\d+\)\]", plan), plan
    assert found.count() == 10


def test_a_crowd_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(cells, "ROWS_A_FILE", 20)
    x = np.concatenate([np.tile([1.0, 2.0, -1.0], (100, 1)), clustered(50, 3, 4)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as little as this would meet in one task again
    try:
        made = cells.build(frame(spark, x), 6)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    crowd = cells.read(spark, made).where("chunk_id < 100")
    assert crowd.select("cell").distinct().count() == 1 and len({r[0] for r in crowd.selectExpr("_metadata.file_path").distinct().collect()}) > 1
    found = cells.search(made, frame(spark, x[:1], "query_id"), probes=1).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == list(range(10))


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1e200, 1e200]), (9, [5e-320, 0.0])], "chunk_id long, vector array<double>")
    made = cells.build(rows)
    asked = rows.withColumnRenamed("chunk_id", "query_id")
    assert pairs(cells.search(made, asked, probes=9)) == {(q, c) for q in (1, 8, 9) for c in (1, 8, 9)}
    none = cells.build(rows.where("chunk_id = 2"))
    assert cells.search(none, asked).count() == 0 and cells.probes_for(none, asked) == 1
    assert cells.search(made, asked.where("query_id = 2")).count() == 0


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_query_recall(spark, sf_dir):
    found = pairs(catalog.queries()["cell_index_top10"](spark, sf_dir))
    exact = pairs(catalog.queries()["dense_rows_top10"](spark, sf_dir))
    assert len(found & exact) >= 0.9 * len(exact)


def test_probes_are_chosen_by_one_search(spark, monkeypatch):
    """The fewest probes of the wanted recall, as trying each number would tell, but from a single search."""
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 6)))], "chunk_id long, vector array<double>")
    index = cells.build(frame, 8)
    asked = frame.where("chunk_id % 30 = 0").withColumnRenamed("chunk_id", "query_id")
    search, calls = cells.search, []
    monkeypatch.setattr(cells, "search", lambda *a: (calls.append(a), search(*a))[1])
    chosen = cells.probes_for(index, asked, 0.9)
    assert len(calls) == 1
    true = {(r.query_id, r.chunk_id) for r in search(index, asked, 10, 8).collect()}
    share = lambda p: sum((r.query_id, r.chunk_id) in true for r in search(index, asked, 10, p).collect()) / len(true)
    assert share(chosen) >= 0.9 and (chosen == 1 or share(chosen - 1) < 0.9)
