"""Batches of queries, vectors without a direction, words written down once, walks over cycles."""

from corpusmith.operators import graph, retrieval

VECTORS = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.5]), (6, [3.0, 0.0])]


def search(spark, k=3):
    vectors = spark.createDataFrame(VECTORS, "chunk_id long, vector array<double>")
    queries = vectors.select(vectors.chunk_id.alias("query_id"), "vector")
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in retrieval.dense(vectors, queries, k).collect())


def test_batches_give_what_one_batch_gives(spark, monkeypatch):
    whole = search(spark)
    assert {q for q, *_ in whole} == {1, 2, 5, 6}
    assert [c for q, _, c, _ in whole if q == 1] == [1, 6, 2]
    # Six rows in four parts of at most three each.
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    assert search(spark) == whole


def test_bm25_of_an_empty_table(spark):
    none = spark.createDataFrame([], "chunk_id long, content string")
    assert retrieval.bm25(none, [(0, "some words")]).collect() == []


def test_walk_over_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "x"), ("b", "e", "x"), ("e", "d", "x")], "src string, dst string, relation string")
    roots = spark.createDataFrame([(0, "a")], "query_id int, concept string")
    rows = {(r.concept, r.depth, ">".join(r.path)) for r in graph.traverse(roots, edges, 4).collect()}
    assert rows == {("a", 0, "a"), ("b", 1, "a>b"), ("c", 2, "a>b>c"), ("e", 2, "a>b>e"), ("d", 3, "a>b>c>d")}
