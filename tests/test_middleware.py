"""Chains of steps and their traces."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmith.operators import middleware
from corpusmith.operators.middleware import Step
from corpusmith.plans import catalog

CUT = Step("cut", "1", lambda c, most: F.substring(c, 1, most), {"most": 5})
ADD = Step("add", "1", lambda c: F.concat(c, F.lit("!")))


def found(rows):
    return {r.id: (r.text, [s["name"] for s in r.trace], r.digest) for r in rows.withColumn("digest", middleware.digest()).collect()}


def test_twice_equals_once(spark):
    rows = spark.createDataFrame([(1, "abcdefgh"), (2, None)], "id int, text string")
    once = middleware.applied(rows, [CUT, ADD])
    assert found(once) == found(middleware.applied(once, [CUT, ADD])) and found(once)[1][:2] == ("abcde!", ["cut", "add"]) and found(once)[2][0] is None


def test_other_settings_or_versions_are_other_steps(spark):
    rows = middleware.applied(spark.createDataFrame([(1, "abcdefgh")], "id int, text string"), [CUT, ADD])
    shorter = middleware.applied(rows, [Step("cut", "1", CUT.apply, {"most": 3})])
    newer = middleware.applied(rows, [Step("add", "2", ADD.apply)])
    assert found(shorter)[1][:2] == ("abc", ["cut", "add", "cut"]) and found(newer)[1][:2] == ("abcde!!", ["cut", "add", "add"])
    assert len({found(x)[1][2] for x in (rows, shorter, newer)}) == 3


def test_rows_of_several_runs_in_one_table(spark):
    rows = spark.createDataFrame([(1, "abcdefgh")], "id int, text string")
    both = middleware.applied(rows, [CUT]).union(middleware.applied(rows.withColumn("id", F.lit(2)), [ADD]))
    got = found(middleware.applied(both, [CUT, ADD]))
    assert got[1][:2] == ("abcde!", ["cut", "add"]) and got[2][:2] == ("abcde", ["add", "cut"])
    late = rows.withColumn("trace", F.lit(None).cast(middleware.TRACE))
    assert found(middleware.applied(late, [ADD]))[1][:2] == ("abcdefgh!", ["add"])


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = catalog.queries()["middleware_chain"](spark, sf_dir).select("doc_id", "text_sha256", "n_steps", "digest").collect()
    want = con.execute(f"SELECT doc_id, text_sha256, n_steps, digest FROM ({catalog.oracle_sql()['middleware_chain']})").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
