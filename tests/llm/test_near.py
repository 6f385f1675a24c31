"""The pipeline's near-duplicate stage against brute force."""

import random

import corpus_pipeline
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from corpusmith.llm import near, simhash


def stage(spark, rows):
    return corpus_pipeline.simhash_stage(spark, rows, "")


def test_edited_copies_go(spark, docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(40):
        words = [word() for _ in range(200)]
        rows.append((k, " ".join(words)))
        for copy, edits in ((1, 2), (2, 3), (3, 60)):  # 60 edits leave the text another one
            other = list(words)
            for at in rng.sample(range(200), edits):
                other[at] = word()
            rows.append((k + 100 * copy, " ".join(other)))
    sets = {d: set(near.shingles(t)) for d, t in rows}
    kept = {r.doc_id for r in stage(spark, docs(rows)).collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and near.jaccard(sets[a], sets[b]) >= near.SIMILAR]
    assert len(pairs) > 60 and not [p for p in pairs if kept >= set(p)]
    assert {d for d in sets if d < 100 or d >= 300} <= kept


def test_rows_go_by_id_and_text(spark, docs):
    text = "one two three four five six seven eight nine ten"
    rows = docs([(5, text), (3, text), (3, text), (9, None), (8, ""), (3, "another text under the same id here"), (None, text.upper()), (None, "words that nobody else has got"), (None, "x")])
    kept = stage(spark, rows)
    assert kept.columns == rows.columns
    want = [(3, text), (3, text), (8, ""), (3, "another text under the same id here"), (None, "words that nobody else has got"), (None, "x")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert stage(spark, docs([])).count() == 0


def test_buckets_of_strangers(spark, docs):
    """What shares keys without being near stays, and near copies within such a bucket go."""
    schema = "key binary, least long, n int, bands array<long>"
    texts = [" ".join(f"{k // 2}w{i}" for i in range(40)) + (" end" if k % 2 else "") for k in range(14)]
    classes = spark.createDataFrame([(bytes([k]), k, 36, [1, 2]) for k in range(14)], schema)
    held = spark.createDataFrame([(bytes([k]), t) for k, t in enumerate(texts)], "key binary, text string")
    assert sorted(r.key[0] for r in near.near_texts(classes, held).collect()) == list(range(1, 14, 2))


def test_a_group_that_is_nearly_near(spark, docs):
    """Texts that share half of their shingles meet under many keys; they stay, copies of them go, and few pairs are made."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = []
    for k in range(120):
        words = base[:60] + [word() for _ in range(60)]
        rows += [(k, " ".join(words)), (k + 1000, " ".join(words[:-1] + [word()]))]
    sets = {d: set(near.shingles(t)) for d, t in rows}
    assert 0.25 < near.jaccard(sets[0], sets[1]) < near.SIMILAR < near.jaccard(sets[0], sets[1000])
    assert sorted(r.doc_id for r in stage(spark, docs(rows)).collect()) == list(range(120))


def template_pages(n, changed, width=200, seed=3):
    """Pages of one template: a stretch of words that each page has for itself among words that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(width)]
    return [(k, " ".join(base[:60] + [word() for _ in range(changed)] + base[60 + changed :])) for k in range(n)]


def tested_pairs(monkeypatch):
    """The numbers of pairs whose sets are compared, filled in as they are."""
    seen, compare = [], near._near
    monkeypatch.setattr(near, "_near", lambda pairs, sets: (seen.append(pairs.count()), compare(pairs, sets))[1])
    return seen


def test_template_pages_cost_few_tests(spark, docs, monkeypatch):
    """A thousand pages at a similarity of 0.7, all under common keys: no pair of them is compared, and near copies go."""
    rows = template_pages(1000, 30)
    sets = [set(near.shingles(t)) for _, t in rows[:2]]
    assert 0.65 < near.jaccard(*sets) < 0.75
    copies = [(k + 5000, t + " tail") for k, t in rows[::20]]
    seen = tested_pairs(monkeypatch)
    assert sorted(r.doc_id for r in stage(spark, docs(rows + copies)).collect()) == list(range(1000))
    assert len(copies) <= sum(seen) <= 2 * len(copies)


def test_no_pair_is_tested_twice(spark, docs, monkeypatch):
    """Forty pages just below the bound, which do meet: each pair once at most, in few rounds."""
    rows = template_pages(40, 20)
    sets = {d: set(near.shingles(t)) for d, t in rows}
    assert 0.76 < near.jaccard(sets[0], sets[1]) < near.SIMILAR
    seen = tested_pairs(monkeypatch)
    assert stage(spark, docs(rows)).count() == 40
    assert sum(seen) <= 40 * 39 // 2 and len(seen) <= 7


def test_recall_at_the_bound(spark, docs):
    """Pairs of 0.8 to 0.86 among strangers of the same words: all but a few in ten thousand must lose one."""
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(400)]
    rows, pairs = [], 0
    for k in range(300):
        words = [rng.choice(pool) for _ in range(rng.randrange(80, 160))]
        other, at = list(words), len(words) // 2
        for j in range(at, at + len(words) // 16):
            other[j] = rng.choice(pool)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        pairs += 0.8 <= near.jaccard(*(set(near.shingles(t)) for _, t in rows[-2:]))
    kept = {r.doc_id for r in stage(spark, docs(rows)).collect()}
    both = sum(near.jaccard(*(set(near.shingles(rows[j][1])) for j in (2 * k, 2 * k + 1))) >= 0.8 and {2 * k, 2 * k + 1} <= kept for k in range(300))
    assert pairs > 200 and both <= 0.005 * pairs and all(2 * k in kept for k in range(300))


def test_a_very_long_text(spark, docs):
    rng = random.Random(2)
    words = [f"{rng.randrange(10**6)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-500])), (3, " ".join(words[60_000:])), (4, "short text of a few words only")]
    assert sorted(r.doc_id for r in stage(spark, docs(rows)).collect()) == [1, 3, 4]


def test_fingerprints_alone_bring_near_copies_together(spark, docs, monkeypatch):
    """Without any MinHash key all near copies within REACH bits go; a text whose fingerprint is near, but not its shingles, stays."""
    rng, sketched = random.Random(6), near.sketched
    rows, bits = [], {}
    for k in range(40):
        words = [f"{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(k, " ".join(words)), (k + 100, " ".join(words[:-1] + ["end"]))]
        bits[k] = (simhash.fingerprint(rows[-1][1], near.WIDTH) ^ simhash.fingerprint(rows[-2][1], near.WIDTH)) & ((1 << 64) - 1)
    close = {k for k, b in bits.items() if b.bit_count() <= near.REACH}
    assert len(close) >= 5
    monkeypatch.setattr(near, "sketched", lambda texts: sketched(texts).withColumn("bands", F.array().cast("array<long>")))
    kept = {r.doc_id for r in stage(spark, docs(rows)).collect()}
    assert set(range(40)) <= kept and not kept & {k + 100 for k in close}


def test_sets_of_a_long_batch_go_on_in_parts(monkeypatch):
    monkeypatch.setattr(near, "BATCH_TOKENS", 100)
    texts = [None, "", "One two", *(" ".join(f"w{(k * i) % 61}" for k in range(60)) for i in range(1, 20)), "the end is the end is the end is the end"]
    rows = pa.RecordBatch.from_arrays([pa.array([bytes([i]) for i in range(len(texts))]), pa.array(texts)], ["key", "text"])
    out = list(near.set_batches(iter([rows, rows.slice(0, 0), rows.slice(3, 2)])))
    assert len(out) > 8 and all(sum(b.column("n").to_pylist()) < 160 for b in out)
    got = [r for b in out for r in b.to_pylist()]
    want = [{xxhash.xxh64_intdigest(p, near.SEED) for p in near.shingles(t)} for t in texts]
    want = [(bytes([i]), x) for i, x in enumerate(want)]
    assert [(r["key"], {t % 2**64 for t in r["tokens"]}) for r in got] == want + want[3:5]
    assert all(r["n"] == len(r["tokens"]) == len(set(r["tokens"])) for r in got)


def test_pipeline_bounds_arrow_batches_by_bytes(spark, sf_dir):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpus_pipeline.bpe_stage(spark, docs, sf_dir)
    try:
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("4m", "4194304", "4194304b")
        # Texts of some 2 MB: a batch of rows would hold all of them, a batch of bytes a few.
        long = spark.range(12, numPartitions=1).select(F.repeat(F.lit("word "), 400_000).alias("text"))
        sizes = long.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in it), "n long").collect()
        assert sum(r.n for r in sizes) == 12 and max(r.n for r in sizes) <= 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
