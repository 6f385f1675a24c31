"""Sharding: balance, gapless slots, hot groups."""

import zlib
from collections import Counter, defaultdict

from corpusmith.llm import queries, shards


def sound(rows, texts, n):
    """rows: (id, size, crc, shard, slot)."""
    slots, sizes = defaultdict(list), Counter()
    for d, size, crc, shard, slot in rows:
        slots[shard].append(slot)
        sizes[shard] += size
    assert len(rows) == len(texts)
    assert sorted((s, c) for _, s, c, _, _ in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(0 <= s < n for s in slots)
    if rows:
        most = max(s for _, s, _, _, _ in rows)
        assert all(abs(sizes[k] - sum(sizes.values()) / n) <= 2 * most for k in range(n))
    return sizes


def assigned(df, n=8):
    return [tuple(r) for r in shards.assign(df, n).collect()]


def test_hot_texts_and_odd_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(shards, "RANGE_ROWS", 20)
    monkeypatch.setattr(shards, "LEAST_RANGES", 8)
    texts = [f"text number {k} " * (k % 7) for k in range(300)] + ["hot text"] * 400 + [None, "", "é" * 50]
    rows = list(enumerate(texts)) + [(None, "x"), (5, texts[5]), (5, texts[5])]
    sound(assigned(docs(rows)), [t for _, t in rows], 8)


def test_one_row_many_times(spark, docs, monkeypatch):
    monkeypatch.setattr(shards, "RANGE_ROWS", 20)
    monkeypatch.setattr(shards, "LEAST_RANGES", 8)
    rows = [(1, "same")] * 500
    sizes = sound(assigned(docs(rows), 4), [t for _, t in rows], 4)
    assert max(sizes.values()) - min(sizes.values()) <= 10


def test_few_rows(spark, docs):
    assert assigned(docs([])) == []
    assert assigned(docs([(7, "abc")]))[0][1:3] == (4, zlib.crc32(b"abc"))


def test_equal_texts_stay_together(spark, docs):
    texts = [f"t{k % 100}" for k in range(600)]
    found = assigned(docs(list(enumerate(texts))))
    where = defaultdict(set)
    for d, _, _, shard, _ in found:
        where[texts[d]].add(shard)
    assert all(len(w) == 1 for w in where.values())


def test_groups_are_whole_unless_too_large(spark, docs, monkeypatch):
    monkeypatch.setattr(shards, "RANGE_ROWS", 20)
    monkeypatch.setattr(shards, "LEAST_RANGES", 16)
    texts = [f"{k}" * 4 for k in range(100, 130) for _ in range(k % 9 * 3)] + ["hot copies"] * 300
    found = assigned(docs(list(enumerate(texts))), 6)
    sizes = Counter()
    where = defaultdict(Counter)
    for d, size, _, shard, _ in found:
        where[texts[d]][shard] += size
        sizes[shard] += size
    each = sum(sizes.values()) / 6
    assert {t for t, w in where.items() if len(w) > 1} == {"hot copies"} and sum(where["hot copies"].values()) > each
    assert all(abs(s - each) <= 2 * max(sum(w.values()) for t, w in where.items() if t != "hot copies") for s in sizes.values())
    slots = defaultdict(list)
    for _, _, _, shard, slot in found:
        slots[shard].append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_text_ids(spark):
    table = spark.createDataFrame([(f"id-{k}", f"text {k}") for k in range(40)] + [(None, "x")], "doc_id string, text string")
    rows = assigned(table)
    assert sorted((r[0] for r in rows), key=str) == sorted([f"id-{k}" for k in range(40)] + [None], key=str)


def test_like_brute_force(spark, docs):
    """Every record where its middle is on the line of all bytes, in order of hash and id; cut groups by their own middle."""
    texts = [f"text {k % 70} " * (k % 11 + 1) for k in range(500)]
    table = docs(list(enumerate(texts)))
    hashes = {r.doc_id: r.x for r in table.selectExpr("doc_id", "xxhash64(text) x").collect()}
    line = sorted((hashes[d], d) for d in hashes)
    total, at, middle, group = sum(len(t) + 1 for t in texts), 0, {}, {}
    for h, d in line:
        size = len(texts[d]) + 1
        middle[d] = at + size / 2
        group.setdefault(h, [at, 0])[1] = at + size
        at += size
    shard = {d: min(7, int(m * 8 / total)) for d, m in middle.items()}
    for h, (a, b) in group.items():
        if b - a <= total / 8:
            shard |= {d: min(7, int((a + b) / 2 * 8 / total)) for d in hashes if hashes[d] == h}
    seen = Counter()
    want = {}
    for _, d in line:
        want[d] = shard[d], seen[shard[d]]
        seen[shard[d]] += 1
    assert {d: (s, slot) for d, _, _, s, slot in assigned(table)} == want


def test_written_shards(spark, docs, tmp_path):
    rows = [(k, f"text {k}") for k in range(50)]
    shards.write_shards(docs(rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows and back.select("shard").distinct().count() == 4


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op9_sharding(spark, sf_dir).collect()
    sound([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows], list(texts.values()), 8)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
