"""Rows written over others, and the columns that follow."""

from pyspark.sql import functions as F

from corpusmith.operators.tables import written

SCHEMA = "id int, content string, lang string, size int, at int"


def after(spark, old, new, schema):
    rows = written(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, schema), ["id"], {"size": ("content", F.length("content"))}, "at", F.lit(9))
    assert rows.columns == ["id", "content", "lang", "size", "at"]
    return sorted(map(tuple, rows.collect()), key=repr)


def test_written(spark):
    # The stored size of row 1 is stale: only a write of its content mends it.
    old = [(1, "abc", "en", 7, 1), (2, "d", "de", 1, 1), (None, "n", None, 1, 1)]
    assert after(spark, old, [(1, "fr")], "id int, lang string") == sorted([(1, "abc", "fr", 7, 9), old[1], old[2]], key=repr)
    assert after(spark, old, [(1, "abcd"), (3, "x")], "id int, content string") == sorted([(1, "abcd", "en", 4, 9), (3, "x", None, 1, 9), old[1], old[2]], key=repr)
    assert after(spark, old, [(2, None)], "id int, content string") == sorted([old[0], (2, None, "de", None, 9), old[2]], key=repr)
    assert after(spark, old, [(4, "it")], "id int, lang string") == sorted([*old, (4, None, "it", None, 9)], key=repr)
    assert after(spark, old, [(None, "m")], "id int, content string") == sorted([*old, (None, "m", None, 1, 9)], key=repr)


def test_empty_tables(spark):
    old = [(1, "abc", "en", 3, 1)]
    assert after(spark, old, [], "id int, content string") == old
    assert after(spark, [], [(1, "ab")], "id int, content string") == [(1, "ab", None, 2, 9)]
