"""Queries of this subpackage that SQL can express give their twins' rows; the pipeline equals its parts."""

import duckdb
import pytest

from corpusmith.llm import bpe, decontam, lines, near, quality, queries


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in found), key=repr)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    twin = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in twin.description]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, twin.fetchall())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash_near_dedup", "decontamination", "bpe"]
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == documents.columns and docs.schema == documents.schema
    # The same by each operator's marks, applied in Python.
    held = {r.doc_id: r for r in documents.collect()}
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    bad = {r.doc_id for r in quality.classify(documents, labels, quality.held_out("doc_id", 3, 1)).collect() if not r.predicted}
    left = spark.createDataFrame([r for d, r in held.items() if d not in bad], documents.schema)
    left = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, len(r.text)) for r in lines.dedup(left).collect()], documents.schema)
    keep = []  # (id, shingles) of documents that are near none of a smaller id
    for r in sorted(left.collect(), key=lambda r: r.doc_id):
        mine = set(near.shingles(r.text))
        if all(near.jaccard(mine, other) < near.SIMILAR for _, other in keep):
            keep.append((r.doc_id, mine))
    keep = {d for d, _ in keep}
    left = spark.createDataFrame([r for r in left.collect() if r.doc_id in keep], documents.schema)
    leaks = {r.doc_id for r in decontam.contaminated(left, benchmark).collect()}
    want = sorted(tuple(r) for r in left.collect() if r.doc_id not in leaks)
    assert sorted(tuple(r) for r in docs.collect()) == want
    tokens = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in tokens.collect()) == [r[0] for r in want]
    assert bpe.encode(docs, queries.vocabulary()).count() == len(want)
