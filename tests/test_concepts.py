"""Mentions, links and ids of concepts."""

import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmith.operators import concepts
from corpusmith.plans import catalog


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, content string, hierarchy array<string>, root string")


def test_links_by_the_first_way(spark):
    rows = [
        (1, "About POSTGRES and [[Spark|the engine]], [[ Guide ]] too", ["Guide", "Install"], "Doc"), (2, "postgresql, doc", None, "Doc"), (3, "[[a]] [[A]] x", [], None),
        (4, None, ["One", "one", ""], "Doc"), (5, "nothing", [], ""),
    ]
    names = spark.createDataFrame([("Postgres",), ("## postgres **",), ("ab",), ("Doc",), ("Spark",), (None,), ("Kafka",)], "name string")
    got = sorted((r.chunk_id, r.concept.lower(), r.confidence) for r in concepts.links(chunk_frame(spark, rows), names).collect())
    assert got == [(1, "guide", 0.8), (1, "install", 1.0), (1, "postgres", 0.75), (1, "spark", 0.7), (2, "doc", 1.0), (2, "postgres", 0.75), (3, "a", 0.7), (4, "one", 0.8)]


def test_a_large_catalogue_goes_in_parts(spark, monkeypatch):
    chunks = spark.range(60).select(F.col("id").alias("chunk_id"), F.concat(F.lit("see Entity"), F.col("id").cast("string"), F.lit("!")).alias("content"))
    names = spark.range(200).select(F.concat(F.lit("entity"), F.col("id").cast("string")).alias("name"))
    whole = sorted(map(tuple, concepts.mentions(chunks, names).collect()))
    assert len(whole) == 60 + 50 and (57, "entity5") in whole
    monkeypatch.setattr(concepts, "PART_BYTES", 300)
    assert sorted(map(tuple, concepts.mentions(chunks, names).collect())) == whole
    assert concepts.mentions(chunks, names.limit(0)).count() == 0


def test_ids_are_name_based_uuids(spark, sf_dir):
    for r in catalog.queries()["concept_uuids"](spark, sf_dir).limit(300).collect():
        ids = [str(uuid.uuid5(uuid.NAMESPACE_URL, f"concept:1:{n.lower()}")) for n in (r.src, r.dst)]
        relation = "located_in" if r.src[0] == "s" else "contains"
        assert r.src_id == ids[0] and r.edge_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"edge:1:{ids[0]}:{ids[1]}:{relation}"))


def test_claims_find_their_chunk(spark):
    chunks = spark.createDataFrame([(10, 1, 0), (11, 1, 1)], "chunk_id long, document long, order int")
    claims = spark.createDataFrame([(1, 0, "a", 0.5, 1), (1, 0, "a", 0.9, 2), (1, 1, "a", 0.4, 1), (1, 7, "a", 1.0, 1), (2, 0, "b", 1.0, 1)], "document long, order int, concept string, confidence double, version int")
    assert sorted(map(tuple, concepts.attach(claims, chunks).collect())) == [(10, "a", 0.9), (11, "a", 0.4)]


@pytest.mark.parametrize("name", ["entity_mentions", "chunk_concepts"])
def test_like_the_twin(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    twin, df = con.execute(catalog.oracle_sql()[name]), catalog.queries()[name](spark, sf_dir)
    names = [d[0] for d in twin.description]
    found = sorted(map(tuple, df.select(*names).collect()))
    assert found and found == sorted(twin.fetchall())
