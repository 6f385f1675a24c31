"""Retrieval from SQL and scans by allowed columns."""

import duckdb
import pytest

from corpusmith.functions import text as tx
from corpusmith.plans import catalog, functions
from corpusmith.sources import scans


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", ["sql_dense_search", "sql_neighbors", "sql_concepts", "sql_counts", "allowed_scan"])
def test_like_the_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    twin, df = con.execute(catalog.oracle_sql()[name]), catalog.queries()[name](spark, sf_dir)
    names = [d[0] for d in twin.description]
    found = sorted(map(tuple, df.select(*names).collect()))
    assert found and found == sorted(twin.fetchall())


def test_functions_in_queries(spark, sf_dir):
    assert len(functions.register(spark, sf_dir)) == len(functions.FUNCTIONS)
    row = spark.sql("SELECT corpus_sanitize_query('  a {b} [c]  d ') AS a, corpus_sanitize_query(NULL) AS b, corpus_document_chunk_count(0) AS n, corpus_embedding_dimension() AS dim").first()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert (row.a, row.b, row.dim, row.n) == ("a b c d", "", 64, turns.where("conv_id = 0").count())
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    assert texts.select(tx.sanitize_query(texts.text).alias("x")).exceptAll(texts.selectExpr("corpus_sanitize_query(text) AS x")).count() == 0
    assert spark.sql("SELECT * FROM corpus_dense_search(array(0D, 0D), 3)").count() == 0


def test_allowed_columns(spark, sf_dir, capsys):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    allowed = {"o_orderkey", "o_orderstatus", "o_custkey"}
    one = scans.fetch(orders, {"o_orderstatus": "F", "o_orderkey": 3}, allowed, ["o_custkey"], 1)
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(o_orderkey,3)" in plan and "EqualTo(o_orderstatus,F)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in plan
    assert scans.fetch(orders, {"o_orderstatus": "' OR 1=1 --"}, allowed).count() == 0
    assert scans.fetch(orders, {"o_custkey": None}, allowed).count() == 0 and scans.fetch(orders, {}, allowed).columns == sorted(allowed)
    for where, columns in (({"o_comment": "x"}, None), ({}, ["o_totalprice"]), ({"o_orderkey; DROP": 1}, None)):
        with pytest.raises(ValueError, match="not allowed"):
            scans.fetch(orders, where, allowed, columns)
    with pytest.raises(ValueError, match="not allowed"):
        scans.database(spark, "jdbc:none", "secrets", {"orders"})
