"""Literal cases of text functions, kernels, fusion, graph and relational operators."""

import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusmith import corpus
from corpusmith.functions import sequential as sq
from corpusmith.functions import text as tx
from corpusmith.operators import evaluate, graph, retrieval, tables
from corpusmith.sources import readers, sinks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def fused(spark, rows, **more):
    df = spark.createDataFrame([(1, *r) for r in rows], "query_id int, list string, pos int, id string")
    return [(r.id, round(r.score, 6)) for r in retrieval.fuse_zero_based(df, **more).orderBy("rank").collect()]


LISTS = [("dense", 0, "doc1"), ("dense", 1, "doc2"), ("dense", 2, "doc3"), ("lex", 0, "doc2"), ("lex", 1, "doc1"), ("lex", 2, "doc4")]


def test_zero_based_fusion(spark):
    found = fused(spark, LISTS)
    assert [f[0] for f in found] == ["doc1", "doc2", "doc3", "doc4"]
    assert abs(found[0][1] - 0.033060) < 1e-5 and abs(found[2][1] - 0.016130) < 1e-5
    assert fused(spark, []) == []


def test_negatives_halve(spark):
    texts = spark.createDataFrame([("doc1", "uses OAuth2"), ("doc2", "plain")], "id string, content string")
    negatives = spark.createDataFrame([(1, ["oauth2"])], "query_id int, terms array<string>")
    rows = [("dense", 0, "doc1"), ("dense", 1, "doc2"), ("lex", 0, "doc2"), ("lex", 1, "doc1")]
    found = dict(fused(spark, rows, texts=texts, negatives=negatives))
    assert abs(found["doc1"] - found["doc2"] / 2) < 1e-6
    by_id = fused(spark, [("dense", 0, "spam_doc"), ("dense", 1, "good_doc")], negatives=spark.createDataFrame([(1, ["spam"])], "query_id int, terms array<string>"))
    assert by_id[0][0] == "good_doc"


def test_sql_fusion(spark):
    d = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id int, chunk_id int, rank int")
    x = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 4, 3)], "query_id int, chunk_id int, rank int")
    found = {r.chunk_id: round(r.score, 6) for r in retrieval.fuse(d, x).collect()}
    assert found == {1: 0.032522, 2: 0.032522, 3: 0.015873, 4: 0.015873}


def test_tiers(spark):
    rows = []
    for q, (kind, best) in enumerate([("r", 2.5), ("r", -0.5), ("r", -3.5), ("f", 0.025), ("f", 0.018), ("f", 0.005), ("d", 0.9), ("d", 0.6), ("d", 0.4)]):
        rows.append((q, best, best if kind == "r" else None, "dense" if kind == "d" else "hybrid"))
    df = spark.createDataFrame(rows, "query_id int, score double, rerank_score double, match_source string")
    tiers = [r.tier for r in retrieval.confidence_tier(df).orderBy("query_id").collect()]
    assert tiers == ["high", "medium", "low"] * 3


def test_gate(spark):
    dense = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.9, 0.88, 0.85, 0.82, 0.8])] + [(2, 0, 0.4), (2, 1, 0.35)], "query_id int, chunk_id int, score double")
    hybrid = spark.createDataFrame([(1, 9, 0.03), (2, 9, 0.03)], "query_id int, chunk_id int, score double")
    assert {(r.query_id, r.match_source) for r in retrieval.gate(dense, hybrid).collect()} == {(1, "dense"), (2, "hybrid")}


def test_middle_last(spark):
    for n, want in ((5, [0, 2, 4, 3, 1]), (4, [0, 2, 3, 1]), (2, [0, 1])):
        df = spark.createDataFrame([(1, k + 1) for k in range(n)], "query_id int, rank int")
        assert [r["rank"] - 1 for r in retrieval.middle_last(df).orderBy("slot").collect()] == want


def test_router(spark):
    assert one(spark, tx.graph_hops, "How does auth depend on tokens?") == 1
    assert one(spark, tx.graph_hops, "define vector search") == 0
    assert one(spark, tx.graph_hops, "  ") == 0


def test_negations(spark):
    for q, clean, terms in (
        ("FastAPI authentication NOT OAuth2", "FastAPI authentication", ["oauth2"]),
        ("PostgreSQL vector search -pinecone -weaviate", "PostgreSQL vector search", ["pinecone", "weaviate"]),
        ("LLM inference without transformers except onnx", "LLM inference", ["transformers", "onnx"]),
    ):
        assert one(spark, tx.clean_query, q) == clean
        assert one(spark, tx.negative_terms, q) == terms


def test_canonical_ids(spark):
    for value, want in (("document_123", "123"), ("chunk:456", "456"), ("doc_API-Guide/v1.0", "api-guide-v1.0")):
        assert one(spark, tx.canonical_id, value) == want
    for value, want in (("Café 7", "cafe-7"), ("Doc Chunk: Ünïted  States ", "united-states"), ("\ufb01le 12", "file-12"), ("x\u00bdy", "x12y"), ("\u2116 7\u2122", "no-7tm"), ("--a!b--_", "ab"), (None, ""), ("日本", "")):
        assert one(spark, tx.canonical_id, value) == want


def test_html(spark):
    assert one(spark, tx.html_to_markdown, "<h1>Title</h1><p>Paragraph with &amp; entity</p>") == "\n# TitleParagraph with & entity\n".strip(" ")


def test_context(spark):
    plain = lambda t: one(spark, tx.distinct_sentences, t)
    text = "## Part 2\n\nRead [the guide](https://guide.test). It is short. It is SHORT! Why not?\n> quoted\n---\n-*-\nend\there  now"
    assert plain(text) == "Part 2\n\nRead the guide (https://guide.test). It is short. Why not? quoted\n\n-*-\nend\there now"
    assert plain("a\n   ### three\n    # four\n# > both") == "a\nthree\n # four\nboth"
    cut = lambda t, n: spark.createDataFrame([(t,)], "x string").select(tx.cut_context(F.col("x"), F.lit(n)).alias("y")).first().y
    assert cut("short", 10) == "short"
    assert cut("one two three", 9) == "one two..." and cut("abcdefghijkl", 5) == "abcde..." and cut("a bcdefghijkl", 8) == "a bcdefg..."


def test_compress(spark):
    rows = [(1, 1, "doc_1", "alpha one"), (1, 2, "doc_1", "beta two"), (1, 3, "doc_2", "gamma"), (1, 4, "doc_3", "Gamma!"), (1, 5, "doc_4", "delta " * 500), (1, 6, "doc_5", "late"), (2, 1, None, None), (2, 2, "", "x")]
    table = spark.createDataFrame(rows, "query_id int, rank int, doc_id string, content string")
    found = sorted((r.query_id, r["rank"], r.token_count) for r in retrieval.compress(table).collect())
    assert found == [(1, 1, 2), (1, 3, 1), (1, 5, 249), (2, 1, 1), (2, 2, 1)]
    assert sorted(r["rank"] for r in retrieval.compress(table, 2).where("query_id = 1").collect()) == [1, 3]


def test_quality(spark):
    one_ = F.lit(1.0)
    every = dict.fromkeys(tx.QUALITY_WEIGHTS, one_)
    df = spark.range(1)
    assert df.select(tx.quality_score(every).alias("q")).first().q <= 1
    for content, n, want in (("```x```", 100, 0.99), ("x", 100, 0.975), ("```x```", 10, 0.945), ("x", 10, 0.93)):
        assert abs(df.select(tx.chunk_quality(F.lit(content), F.lit(n)).alias("q")).first().q - want) < 1e-9


SAMPLE = "# One\n\nalpha beta gamma delta\n\n## Two\n\nmore words here\n\n```python\n# no heading\n```\n\n## Three\n\nlast part of it\n"


def test_pack():
    assert [b[0] for b in sq.blocks(SAMPLE)] == ["heading", "paragraph", "heading", "paragraph", "code", "heading", "paragraph"]
    made = sq.pack(SAMPLE, 480, 5)
    assert len(made) >= 2 and made == sq.pack(SAMPLE, 480, 5)
    assert sq.pack("") == [] and sq.pack("just text") == ["just text"]
    assert sq.pack("```\nopen fence") == ["```\nopen fence"]
    assert len(sq.sections(SAMPLE + "\n# Four\n" + "word " * 300, 480, 5)) == 3  # a comment line in code counts as a heading here


def test_chunk_documents(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, None), (3, "")], "doc_id long, text string")
    rows = sq.chunk_documents(df, 480, 5).collect()
    assert {r.doc_id for r in rows} == {1}
    assert [r.chunk_order for r in rows] == list(range(len(rows)))


def test_concepts():
    g = sq.extract("# A\n## B\ntext\n### C\n## Dependencies\nuses [[Core Lib]]\n", "Guide", (), ["Tennessee", "Florida"])
    edges = {(s, t, k[2]) for k, (s, t) in g.edges.items()}
    assert {("Guide", "A", "contains"), ("A", "B", "contains"), ("B", "C", "contains"), ("A", "Dependencies", "contains"), ("Dependencies", "Core Lib", "depends_on")} <= edges
    assert not sq.extract("").concepts
    g = sq.extract("x", "Guide", [("see [[Hermes Agent]]", ["Pipeline", "Ingest"]), ("plain", None)])
    assert g.links == [(0, "Pipeline", 0.8), (0, "Ingest", 1.0), (0, "Hermes Agent", 0.7), (1, "Guide", 1.0)]
    g = sq.extract("Tennessee borders Georgia", "Doc", (), ["Tennessee", "Georgia", "Florida"])
    assert {t for _, t in g.edges.values()} == {"Tennessee", "Georgia"}


def test_traverse(spark):
    edges = spark.createDataFrame([("1", "2", "a"), ("2", "3", "a"), ("3", "1", "a"), ("1", "2", "b")], "src string, dst string, relation string")
    roots = spark.createDataFrame([(0, "1")], "query_id int, concept string")
    found = sorted((r.concept, r.depth, r.path) for r in graph.traverse(roots, edges, 2).collect())
    assert found == [("1", 0, ["1"]), ("2", 1, ["1", "2"]), ("3", 2, ["1", "2", "3"])]
    assert graph.traverse(roots, edges, 0).count() == 1


def test_toc_and_links(spark):
    text = "# T\n- [a](#a)\n- [b](#b)\n- [c](#c)\n## Contents\nbody"
    once = one(spark, tx.strip_toc, text)
    assert "(#a)" not in once and "Contents" not in once and one(spark, tx.strip_toc, once) == once
    item = "- [a](#a)\n"
    assert one(spark, tx.strip_toc, f"x\n{item}\n {item}  1. [b](#b) \n\n\ny\n{item}{item}z") == f"x\n\ny\n{item}{item}z"
    assert one(spark, tx.strip_toc, f"{item * 3}- [last](#l)") == "- [last](#l)" and one(spark, tx.strip_toc, f"{item * 3}## INDEX \n\n\ttext\n#toc\n") == "text\n#toc"
    assert one(spark, tx.strip_toc, item * 20_000 + "end") == "end" and one(spark, tx.strip_toc, None) is None
    link = one(spark, tx.clean_links, "[x](https://a.b/c?utm_source=1&q=2&e=) [y](rel?ref=1) end")
    assert link == "[x](https://a.b/c?q=2) [y](rel?ref=1) end" == one(spark, tx.clean_links, link)
    assert one(spark, tx.clean_links, "none here") == "none here"
    for url, want in (("https://h/p?token=abc==&x=1", "https://h/p?token=abc%3D%3D&x=1"), ("https://h/p?a=b+c&REF=z#f", "https://h/p?a=b+c#f"), ("https://h/?a=%7E%2a~", "https://h/?a=~%2A~"), ("p?ref=1", "p?ref=1"), ("HTTPS://H/p?a=1&b=2&a=3#", "https://H/p?a=1&a=3&b=2"), ("http://h/?", "http://h/"), ("http://h?utm_source=1&x=%201", "http://h?x=+1")):
        assert one(spark, tx.clean_url, url) == want
    assert sq.config_hash({"t": 0.3}) != sq.config_hash({"t": 0.9})


def test_json_repair(spark):
    assert one(spark, tx.repaired_json, 'x ```json\n{"a": 1,}\n``` y') == '{"a": 1}'


def test_errors(spark):
    assert one(spark, tx.error_class, "HTTP 429") == "rate_limit"
    assert one(spark, tx.error_class, None) == "invalid_benchmark_row"


def test_citations(spark):
    assert one(spark, tx.has_citation, "as in [1].") and not one(spark, tx.has_citation, "none")
    assert one(spark, tx.abstains, "No matching knowledge was found.")


def test_at_five(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a", "b"]), (2, [], ["a"]), (3, ["z"], ["a", "z"])], "query_id int, expected array<string>, got array<string>")
    found = {r.query_id: (r.recall_at_5, r.precision_at_5, r.mrr) for r in evaluate.at_five(df).collect()}
    assert found == {1: (1.0, 1.0, 1.0), 2: (None, None, None), 3: (1.0, 0.5, 0.5)}


def test_percentile_by_index(spark):
    df = spark.createDataFrame([("a", k) for k in range(100)] + [("b", 1)] * 3, "key string, x int")
    assert {r.key: r.x for r in evaluate.percentile_by_index(df, "key", "x", 0.95).collect()} == {"a": 95, "b": 1}


def test_tenant_scope(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "tenant int, collection string")
    assert corpus.scoped(df, None).count() == 0
    assert corpus.scoped(df, 1).count() == 1 and corpus.scoped(df, 1, "b").count() == 0


def test_ingest_once(spark):
    old = spark.createDataFrame([("c", "h1")], "collection string, content_hash string")
    new = spark.createDataFrame([("c", "h1", 1), ("c", "h2", 2), ("c", "h2", 3), ("d", "h1", 4)], "collection string, content_hash string, doc_id int")
    assert sorted(r.doc_id for r in tables.ingest_new(old, new).collect()) == [2, 4]


def test_quota(spark):
    at = datetime.datetime(2024, 1, 1)

    def admitted(tokens, limit):
        df = spark.createDataFrame([Row(event_id=i, tenant=1, ts=at, tokens=t) for i, t in enumerate(tokens)])
        return [(r.admitted, r.used) for r in tables.quota(df, limit).orderBy("event_id").collect()]

    assert admitted([60, 60, 60], 120) == [(True, 60), (True, 120), (False, 120)]
    assert admitted([500, 10, 10], 200) == [(False, 0), (True, 10), (True, 20)]
    assert [a for a, _ in admitted([500, 10], 0)] == [True, True]


def test_cache(spark):
    from corpusmith.operators import service

    at = datetime.datetime(2024, 1, 1)
    rows = [(k, "a" if k < 9 else "b", at + datetime.timedelta(minutes=m)) for k, m in enumerate([0, 50, 100, 150, 160, 161])] + [(10, "b", at)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp")
    found = {r.id: r.hit for r in service.cache_hits(df, ["key"]).collect()}
    assert found == {0: False, 1: True, 2: False, 3: True, 4: False, 5: True, 10: False}


def test_simulated_search(spark):
    from corpusmith.operators import service

    chunks = spark.createDataFrame([(10, 0, "Tokens and keys"), (11, 1, "a token"), (12, 2, "nothing")], "chunk_id int, place int, content string")
    found = {r.chunk_id: round(r.score, 6) for r in service.keyword_scores(chunks, [(1, "token KEY token")]).collect()}
    assert found == {10: 2.0, 11: round(1 / 1.1, 6)}


def test_negation_after_reranking(spark):
    rows = spark.createDataFrame([(1, 1, "plain", 1.0, 0.5), (1, 2, "has OAuth2", 2.5, 0.6), (2, 1, "x", None, 0.2), (2, 2, "oauth2", None, 0.3)], "query_id int, chunk_id int, content string, rerank_score double, score double")
    found = sorted((r.query_id, r["rank"], r.chunk_id, r.rerank_score, r.score) for r in retrieval.negate_reranked(rows, F.array(F.lit("oauth2"))).collect())
    assert found == [(1, 1, 1, 1.0, 0.5), (1, 2, 2, 0.5, 0.3), (2, 1, 1, None, 0.2), (2, 2, 2, None, 0.15)]


def test_valid_rows(spark):
    long = "a sound answer that is long enough to pass"
    rows = [(long, ["t"], ["1"]), (long + "...", ["t"], ["1"]), ("short", ["t"], ["1"]), (long, [" "], ["1"]), (long, ["t"], ["1"] * 5)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, answer string, texts array<string>, ids array<string>")
    df = df.selectExpr("id", "answer", "exists(texts, t -> trim(t) <> '') AS has_text", "size(ids) AS n_ids", "size(array_distinct(ids)) AS n_distinct")
    assert [r.valid for r in tables.valid_rows(df).orderBy("id").collect()] == [True, False, False, False, False]


def test_audit(spark):
    data = spark.createDataFrame([("open_a",), ("secret.b",), ("other",)], "name string")
    manifest = spark.createDataFrame([("open_*", "true"), ("secret.*", "false")], "pattern string, redistributable string")
    assert {r.name: r["class"] for r in tables.audit(data, manifest).collect()} == {"open_a": "safe", "secret.b": "blocked", "other": "unknown"}


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hello\nworld")
    (tmp_path / "b.html").write_text("<h2>T</h2><p>x</p>")
    (tmp_path / "c.csv").write_text("module,status\nauth,passed\ningest,failed\n")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 \x00\x01 embedded readable text of this file \xff\xfe and some more text")
    (tmp_path / "e.bin").write_bytes(bytes([0, 255, 254, 1] * 8))
    # Spark's file source lists no empty files, so one is put in by hand.
    none = spark.createDataFrame([("/f.txt", 0, bytearray())], "path string, length long, content binary")
    good, bad = readers.parse(readers.files(spark, str(tmp_path)).unionByName(none))
    found = {r.path.rsplit("/", 1)[1]: r for r in good.collect()}
    assert set(found) == {"a.md", "b.html", "c.csv", "d.pdf"}
    assert found["c.csv"].text.startswith("| module | status |") and "| auth | passed |" in found["c.csv"].text
    assert found["d.pdf"].confidence < 0.5 and found["d.pdf"].warning and "embedded readable text" in found["d.pdf"].text
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in bad.collect()} == {"e.bin": "no text", "f.txt": "empty"}


def test_sinks(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k, f"t{k}", at + datetime.timedelta(days=k)) for k in range(25)] + [(99, " ", at)], "id int, content string, created_at timestamp")
    sinks.write_shards(rows.coalesce(1), str(tmp_path / "out"), 10)
    assert len(list((tmp_path / "out").glob("part-*.parquet"))) == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 25
    new, mark = sinks.delta(rows, at + datetime.timedelta(days=20))
    assert new.count() == 4 and mark == at + datetime.timedelta(days=24)
    assert sinks.delta(rows, mark)[0].count() == 0 and sinks.delta(rows, mark)[1] == mark
    pieces = list(sinks.answer_stream(spark.createDataFrame([(1, "x" * 1200)], "query_id int, answer string")))
    assert [len(p) for _, p in pieces] == [500, 500, 200]


def test_retrieval_set(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text("\n".join(f'{{"_id": "{k}", "title": "t", "text": "x"}}' for k in range(5)))
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "a"}\n{"_id": "q2", "text": "b"}')
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq1\t3\t1\n")
    docs, asked, _ = readers.retrieval_set(spark, str(tmp_path), 2)
    assert sorted(r._id for r in docs.collect()) == ["0", "1", "3"] and [r._id for r in asked.collect()] == ["q1"]


def test_stream_ingest(spark, sf_dir, tmp_path):
    from corpusmith.streaming import flows

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(50).write.parquet(str(tmp_path / "in"))
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        flows.ingest(spark, str(tmp_path / "in"), docs.schema, target, state).awaitTermination()
    docs.limit(50).write.mode("append").parquet(str(tmp_path / "in"))
    flows.ingest(spark, str(tmp_path / "in"), docs.schema, target, state).awaitTermination()
    assert spark.read.parquet(target).count() == docs.limit(50).select("source", "text").distinct().count()


def test_all_tables_or_none(spark, tmp_path):
    import pytest

    from corpusmith.operators import service

    target = str(tmp_path / "store")
    service.store_atomically({"documents": spark.range(3), "chunks": spark.range(5)}, target)
    assert spark.read.parquet(f"{target}/chunks").count() == 5
    with pytest.raises(Exception):
        service.store_atomically({"documents": spark.range(1), "chunks": spark.range(1).selectExpr("assert_true(id > 5)")}, str(tmp_path / "other"))
    assert [p.name for p in tmp_path.iterdir()] == ["store"]


def test_keys_and_gates(spark):
    from corpusmith.operators import service

    now = datetime.datetime(2024, 1, 1)
    keys = spark.createDataFrame([("a", True, None, None), ("b", False, None, None), ("c", True, now, None), ("d", True, None, now)], "token string, is_active boolean, expires_at timestamp, revoked_at timestamp")
    keys = keys.withColumn("key_hash", F.sha2("token", 256)).drop("token")
    assert [r.token for r in service.authenticate(spark.createDataFrame([(t,) for t in "abcdx"], "token string"), keys, now).collect()] == ["a"]
    asked = spark.createDataFrame([(1, 5, False), (2, 3, True), (3, 3, True), (4, 2, True)], "query_id int, depth int, asked boolean")
    rows = spark.createDataFrame([(2, "dense", 0.9), (3, "dense", 0.6)], "query_id int, match_source string, score double")
    assert {r.query_id: r.rerank for r in service.wants_rerank(asked, rows).collect()} == {1: True, 2: False, 3: True, 4: False}
    modes = spark.createDataFrame([("depends on x", 3, None), ("depends on x", 1, None), ("y", 4, 2)], "query string, depth int, hops int")
    assert [(r.mode, r.walk) for r in service.hop_mode(modes).collect()] == [("auto", 1), ("concept_direct", 0), ("manual", 2)]
    blank = spark.createDataFrame([(1, 1, " ")], "query_id int, rank int, content string")
    assert service.fallback_answers(blank).first().answer == "No matching knowledge was found."


def test_chunks_go_on_by_bytes(monkeypatch):
    """Whatever rows a batch holds, chunks leave in batches of bounded size, and none is lost."""
    import pyarrow as pa

    from corpusmith.functions import sequential

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(sequential, "BATCH_BYTES", 10_000)
    texts = [None, ""] + [f"# title {k}\n" + "some words of a text\n" * 200 for k in range(50)]
    run = sequential.chunk_documents(Docs(), how=sequential.sections)
    out = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])])))
    assert len(out) > 10 and all(sum(map(len, b.column(2).to_pylist())) < 10_000 + 4_000 for b in out)
    want = [(d, k, c, sequential.n_tokens(c)) for d, t in enumerate(texts) for k, c in enumerate(sequential.sections(t or ""))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_hash_embedding_of_shared_ids(spark, tmp_path, monkeypatch):
    """Rows that share an id, null among them, are one document; only these are summed across tasks."""
    import hashlib
    import math

    import pytest

    from corpusmith.plans import catalog

    rows = [(1, "a b a\u00e9 A"), (2, "x y"), (2, " y\tz\n"), (None, "q"), (None, "q r"), (3, None), (4, ""), (5, "lone")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sums = {}
    for d, text in rows:
        for w in (text or "").lower().split():
            h = hashlib.sha256(w.encode()).digest()
            key = (d, int.from_bytes(h[:4], "big") % 768)
            sums[key] = sums.get(key, 0) + (1 if h[4] % 2 else -1)
    norm = lambda d: math.sqrt(sum(x * x for (e, _), x in sums.items() if e == d))
    want = {k: round(x / norm(k[0]), 8) for k, x in sums.items() if x}
    seen, small = [], catalog.small
    monkeypatch.setattr(catalog, "small", lambda df: (seen.extend(r[0] for r in df.collect()), small(df))[1], raising=False)
    got = catalog.queries()["hash_embedding"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.dim): r.x for r in got} == pytest.approx(want, abs=1e-8) and len(got) == len(want)
    assert sorted(seen, key=str) == [2, None]
