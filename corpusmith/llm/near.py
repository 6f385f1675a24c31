"""Near-duplicates by word shingles: one document of each group of near copies stays.

Two texts are near copies if the sets of their WIDTH-word shingles have a Jaccard
similarity of SIMILAR or more. Texts are in question whose SimHash fingerprints (of the
same shingles) agree under one of the covering masks of corpusmith.llm.simhash: all within
REACH bits do. As near copies at 0.8 differ by up to 11 bits, so are those that share
a key of BANDS keys of DEEP minima each; a pair at 0.8 exactly has a chance of 0.9996 to,
a closer one a higher chance.

Of the texts in question every shingle's frequency is counted, and a text's shingles
are put in order from the rarest up. Two sets of n and m shingles that are near
share at least o = ceil(SIMILAR / (1 + SIMILAR) * (n + m)) of them, so the first that
they share stands among the first n - o + 1 of the one and the first m - o + 1 of the
other. A pair is tested only if such a shingle joins it: near copies always are,
texts that share a template's frequent shingles and differ in rare ones are not,
however many there are. Links are decided by the exact similarity of the sets.

Equal texts are one class, named by their smallest id. In each bucket of a shingle
the first classes by id lead: whatever is near a leader goes, and what went leads
and follows nowhere any more; the rest of the bucket goes on to the next round with
twice as many leaders, until each has led or gone. No pair is tested twice. So no two
that stay and met are near copies, and each that went is near one of a smaller id. A
group of near copies costs a link for each member, never its pairs, and nothing
is capped.

Defined results: words are split and lower-cased as for SimHash; fewer words than
a shingle make one shingle; null and blank texts are one class; null ids come
last; rows that repeat an id and a text are one document and stay together. Rows
are known by id and text, so nothing else goes with them.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.llm import simhash
from corpusmith.llm.common import drop, fresh, save, small

WIDTH, SIMILAR, BANDS, DEEP, SEED = 5, 0.8, 20, 5, 42
#: Bits by which fingerprints may differ and are sure to meet.
REACH = 3
#: What a product of whole numbers and SIMILAR may be off by.
TINY = 1e-9
#: Shingles whose minima are taken at once. Tokens of sets handed to one Arrow output batch.
CHUNK, BATCH_TOKENS = 1 << 12, 1 << 18


def shingles(text: str | None) -> list[bytes]:
    words = (text or "").encode().lower().split()
    if len(words) < WIDTH:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(WIDTH)))))


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def bands(text: str | None, count: int = BANDS, deep: int = DEEP) -> tuple[int, list[int]]:
    """The number of distinct shingles and the keys of their bands, none for a blank text."""
    import xxhash

    parts = shingles(text)
    if not parts:
        return 0, []
    hashes = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts)))
    rng = np.random.default_rng([SEED, count, deep])
    turns = rng.integers(0, 1 << 31, count * deep, np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, count * deep, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(count * deep, (1 << 32) - 1, np.uint32)
    for k in range(0, len(high), CHUNK):
        turned = high[k : k + CHUNK, None] * turns
        turned += shifts
        np.minimum(least, turned.min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(count, deep))]
    return len(hashes), [k - (1 << 64) if k >> 63 else k for k in keys]


def text_key(text):
    """16 bytes that stand for a text; blank ones share theirs."""
    return F.unhex(F.md5(F.when(text.rlike(r"\S"), text).otherwise("")))


def sketched(texts: DataFrame, count: int = BANDS, deep: int = DEEP) -> DataFrame:
    """(key, n, bands, fp) of texts (key, text); fp is the SimHash fingerprint."""

    def batches(it):
        for batch in it:
            found = [(*bands(t.as_py(), count, deep), simhash.fingerprint(t.as_py(), WIDTH)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.int64())], ["key", "n", "bands", "fp"])

    return texts.select("key", "text").mapInArrow(batches, "key binary, n int, bands array<long>, fp long")


def with_fingerprints(sketches: DataFrame) -> DataFrame:
    """sketches with the buckets of their fingerprints among their keys, one for each of SimHash's covering masks; none for a blank text."""
    tables = (F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(simhash.masks(REACH)))
    return sketches.withColumn("bands", F.when(F.col("n") > 0, F.concat(F.array(*tables), "bands")).otherwise(F.col("bands"))).drop("fp")


def set_batches(batches):
    """Batches (key, n, tokens) of batches (key, text), cut after BATCH_TOKENS tokens, so that a long batch of texts never has all its sets in memory."""
    import xxhash

    def made(keys, tokens):
        return pa.RecordBatch.from_arrays([keys, pa.array(map(len, tokens), pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], ["key", "n", "tokens"])

    for batch in batches:
        start, held, tokens = 0, 0, []
        for row, text in enumerate(batch.column(1)):
            parts = shingles(text.as_py())
            tokens.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))).view(np.int64))
            held += len(tokens[-1])
            if held >= BATCH_TOKENS or row == batch.num_rows - 1:
                yield made(batch.column(0).slice(start, row + 1 - start), tokens)
                start, held, tokens = row + 1, 0, []


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(key, n, tokens) of texts (key, text): the hashes of their distinct shingles."""
    return texts.select("key", "text").mapInArrow(set_batches, "key binary, n int, tokens array<long>")


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, key, n, place): of each set the shingles that can be the first it shares with a near one, by their place
    in the set's order from the rarest up. Those that no other set has are counted, but not listed."""
    tokens = sets.select("key", "n", F.explode("tokens").alias("token"))
    often = save(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"), "near-often")
    held = tokens.join(often, "token").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("held"))
    alone = F.col("n") - F.size("held")
    most = F.col("n") - F.ceil(F.col("n") * SIMILAR - TINY).cast("int") + 1
    listed = F.slice("held", 1, F.greatest(F.lit(0), most - alone))
    return held.select("key", "n", alone.alias("alone"), F.posexplode(listed).alias("at", "x")).select("x.token", "key", "n", (F.col("alone") + F.col("at")).alias("place"))


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows whose shingle others have too."""
    return rows.join(rows.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token"), "token")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(key): the v of those pairs (u, v) whose whole sets are near."""
    both = pairs.join(sets.select(F.col("key").alias("v"), F.col("tokens").alias("v_tokens")), "v")
    both = both.join(sets.select(F.col("key").alias("u"), F.col("tokens").alias("u_tokens")), "u")
    shared = F.size(F.array_intersect("u_tokens", "v_tokens"))
    both = both.withColumn("shared", shared).where(F.col("shared") / (F.size("u_tokens") + F.size("v_tokens") - F.col("shared")) >= SIMILAR)
    return both.select(F.col("v").alias("key")).distinct()


def near_texts(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(key): the classes that go. classes: (key, least, n, bands), texts: (key, text), one row per key."""
    rank = F.struct(F.col("least").isNull().alias("none"), "least", "key")
    rows = classes.select("key", F.explode("bands").alias("token"))
    asked = save(_crowded(save(rows, "near-bands")).select("key").distinct(), "near-candidates")
    held = texts.join(small(asked), "key", "left_semi").dropDuplicates(["key"])
    sets = save(shingle_sets(held), "near-sets")
    rows = save(prefixes(sets), "near-prefixes").join(classes.select("key", rank.alias("rank")), "key")
    left = save(_crowded(save(rows, "near-ranked")), "near-members")
    gone, tested, leaders = None, None, 1
    while not left.isEmpty():
        by_rank = Window.partitionBy("token").orderBy("rank")
        lead = left.withColumn("at", F.row_number().over(by_rank)).where(F.col("at") <= leaders)
        lead = save(lead.select("token", *(F.col(c).alias(f"u_{c}") for c in ("key", "rank", "n", "place"))), "near-leaders")
        pairs = left.join(lead, "token").where(F.col("u_rank") < F.col("rank"))
        overlap = F.ceil((F.col("n") + F.col("u_n")) * (SIMILAR / (1 + SIMILAR)) - TINY)
        # Sets whose sizes differ by more cannot be as similar, nor those that share no shingle so far ahead.
        pairs = pairs.where((F.least("n", "u_n") >= F.greatest("n", "u_n") * SIMILAR - TINY) & (F.col("place") <= F.col("n") - overlap) & (F.col("u_place") <= F.col("u_n") - overlap))
        pairs = pairs.select(F.col("u_key").alias("u"), F.col("key").alias("v")).distinct()
        pairs = save(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "near-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        went = save(_near(pairs, sets), "near-gone")
        gone = went if gone is None else gone.union(went)
        led = lead.select("token", F.col("u_key").alias("key"))
        rest = save(left.join(small(went), "key", "left_anti").join(led, ["token", "key"], "left_anti"), "near-rest")
        drop(left)
        left, leaders = save(_crowded(rest), "near-members"), 2 * leaders
        drop(rest)
    return gone if gone is not None else classes.select("key").limit(0)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that stay, columns as they are."""
    rows = save(docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key")), "near-rows")
    # A class has its smallest id; nulls are left out of a minimum.
    named = save(rows.groupBy("key").agg(F.min("id").alias("least")), "near-classes")
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    sketches = save(sketched(texts), "near-sketches").dropDuplicates(["key"])
    away = near_texts(named.join(with_fingerprints(sketches), "key"), texts).withColumn("away", F.lit(True))
    marks = rows.join(named.join(small(away), "key", "left"), "key").where(F.col("away").isNotNull() | ~F.col("id").eqNullSafe(F.col("least")))
    same_id, same_key = fresh(docs, "__id", "__key")
    marks = small(save(marks.select(F.col("id").alias(same_id), F.col("key").alias(same_key)).distinct(), "near-marks"))
    same = F.col(id_col).eqNullSafe(F.col(same_id)) & (text_key(F.col(text_col)) == F.col(same_key))
    return docs.join(marks, same, "left_anti")
