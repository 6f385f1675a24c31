"""What is taken in and what is refused, and why."""

import duckdb
import pytest

from corpusmith.plans import catalog
from corpusmith.sources import readers

ID = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def test_raw_texts(spark):
    rows = [("a", None), ("a", ""), ("a", ID), ("a", ID.replace("-", "").upper()), ("a", "src1"), (None, None), (" \n \t", None), ("x" * 100_000, None), ("x" * 100_001, "src1"), ("", "src1")]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, raw_text string, collection_id string")
    got = [r.reason for r in readers.raw_texts(frame).orderBy("id").collect()]
    assert got == [None] * 4 + ["collection is no UUID", "blank", "blank", None, "too long", "blank"]


def test_uploads(spark, monkeypatch):
    monkeypatch.setattr(readers, "MOST_BYTES", 5)
    rows = [(b"abc", None), (b"abc", ""), (b"abc", '{"a": [1, {"b": null}]}'), (b"abc", "[1]"), (b"abc", "7"), (b"abc", "{a"), (b"", "{}"), (None, None), (b"abcdef", "{a")]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, content binary, metadata string")
    got = [(r.reason, r.user_metadata) for r in readers.uploads(frame).orderBy("id").collect()]
    assert got == [(None, "{}"), (None, "{}"), (None, '{"a":[1,{"b":null}]}'), (None, "{}"), (None, "{}"), ("metadata is no JSON", "{}"), ("empty", "{}"), ("empty", "{}"), ("too large", "{}")]


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = catalog.queries()["raw_ingest"](spark, sf_dir).select("outcome", "n", "chars").collect()
    want = con.execute(f"SELECT outcome, n, chars FROM ({catalog.oracle_sql()['raw_ingest']})").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 1
