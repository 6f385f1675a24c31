"""Retrieval from SQL: table and scalar functions over a folder's tables, for use with LATERAL.

register() makes the views and functions of one folder known to the session under a
prefix; they are plain SQL, so Catalyst plans them with the query around them.
A call for each row of a table becomes one join, not a loop.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusmith import corpus

DOT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"

#: name(parameters) -> what it returns and the query behind it; {p} is the prefix of views.
FUNCTIONS = {
    "dense_search(asked ARRAY<DOUBLE>, most INT)": (
        "TABLE (chunk_id BIGINT, score DOUBLE, place INT)",
        f"""SELECT chunk_id, score, place FROM (
              SELECT chunk_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS place FROM (
                SELECT v.chunk_id, {DOT.format('v.vector', 'asked')} / (sqrt({DOT.format('v.vector', 'v.vector')}) * sqrt({DOT.format('asked', 'asked')})) AS score
                FROM {{p}}vectors v WHERE exists(v.vector, x -> x <> 0) AND exists(asked, x -> x <> 0)) WHERE score IS NOT NULL) WHERE place <= most""",
    ),
    "neighbor_chunks(anchor BIGINT, anchor_place INT, width INT)": (
        "TABLE (doc BIGINT, place INT, role STRING)",
        "SELECT t.conv_id, t.turn, t.role FROM {p}turns t WHERE t.conv_id = anchor AND t.turn BETWEEN anchor_place - width AND anchor_place + width",
    ),
    "linked_chunks(name STRING)": ("TABLE (chunk_id BIGINT, confidence DOUBLE)", "SELECT l.chunk_id, l.confidence FROM {p}links l WHERE l.concept = name"),
    "concepts_beside(name STRING)": ("TABLE (concept STRING, relation STRING)", "SELECT DISTINCT e.dst, e.relation FROM {p}edges e WHERE e.src = name"),
    "collection_document_count(name STRING)": ("BIGINT", "(SELECT count(*) FROM {p}chunks c WHERE c.collection = name)"),
    "document_chunk_count(doc BIGINT)": ("BIGINT", "(SELECT count(*) FROM {p}turns t WHERE t.conv_id = doc)"),
    "embedding_dimension()": ("INT", "(SELECT max(size(vector)) FROM {p}vectors)"),
    "sanitize_query(asked STRING)": (
        "STRING",
        r"""(SELECT CASE WHEN length(q) > 200 THEN rtrim(substring(q, 1, 197)) || '...' ELSE q END
            FROM (SELECT trim(regexp_replace(regexp_replace(trim(coalesce(asked, '')), r'[`{{}}\[\]<>|\\]+', ' '), r'\s+', ' ')) AS q))""",
    ),
}


def register(spark: SparkSession, sf_dir: str, prefix: str = "corpus_") -> list[str]:
    """Make the functions over sf_dir's tables known; their names."""
    views = {
        "vectors": corpus.table(spark, sf_dir, "embeddings").selectExpr("vec_id AS chunk_id", "embedding AS vector"),
        "turns": corpus.table(spark, sf_dir, "conversations"), "chunks": corpus.chunks(spark, sf_dir), "links": corpus.links(spark, sf_dir), "edges": corpus.edges(spark, sf_dir),
    }
    for name, rows in views.items():
        rows.createOrReplaceTempView(f"{prefix}{name}")
    for head, (returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURNS {returns} RETURN {body.format(p=prefix)}")
    return [prefix + head.split("(")[0] for head in FUNCTIONS]
