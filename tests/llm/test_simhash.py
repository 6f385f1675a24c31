"""SimHash classes against brute force."""

import random

import xxhash

from corpusmith.llm import queries, simhash


def brute_fingerprint(text):
    words = bytes((text or "").encode()).lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps: dict):
    """Smallest key reachable over links of two bits or fewer."""
    keys, parent = sorted(fps), {k: k for k in fps}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_masks_cover():
    masks = [m & (1 << 64) - 1 for m in simhash.masks()]
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        text = " \t".join(rng.choice(["Alpha", "beta", "ÄÖ", "c"]) for _ in range(n))
        assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0 == simhash.fingerprint(" \n ")


def test_components_of_fingerprints(spark):
    """Chains, dense balls and strangers."""
    rng = random.Random(2)
    fps = set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(40):  # a chain of steps of one or two bits, with side steps
            at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps |= {at, at ^ 1 << rng.randrange(64)}
    ball = rng.getrandbits(64)
    fps |= {ball ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(12)} | {rng.getrandbits(64) for _ in range(100)}
    signed = {simhash._signed(f): f for f in fps}
    want = brute_classes(signed)
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    for r in edges.collect():
        assert r.u < r.v and (signed[r.u] ^ signed[r.v]).bit_count() <= 2
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {f: roots.get(f, f) for f in signed} == want


def test_rows(spark, docs):
    text = "one two three four five six seven eight nine ten"
    rows = docs([(5, text), (3, text), (3, text), (9, None), (8, ""), (1, "quite another text about other things"), (None, text)])
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=repr)
    assert found == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (1, 1), (None, 3)], key=repr)
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 3, 8]
    assert simhash.near_duplicates(docs([])).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    want = brute_classes(fps)
    found = queries.op2_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {d: (f"{fps[d]:016x}", want[d]) for d in texts} and len(found) == len(texts)
