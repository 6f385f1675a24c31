"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position i gets a nonzero vector phi(i) of RADIUS + 1 bits. For each
nonzero vector v there is one table whose mask keeps the bits i with odd
<phi(i), v>. Two fingerprints that differ in at most RADIUS bits leave a v that
is orthogonal to phi of all of these, so they agree under that v's mask: every
pair within the radius meets in some table.

A bucket of two is compared outright. In a larger bucket each fingerprint is
put under itself and under itself with one unmasked bit turned; two fingerprints
meet under one of these if and only if they differ in at most two bits, so the
members of such a cell are all linked and a star from the smallest says it all.
Cells hold no more fingerprints than a word has bits. No pairs within a group
are made and nothing is capped. Components come from contracting the links.

Defined results: a null or blank text has fingerprint zero and links like any
other; fewer words than a shingle make one shingle; equal fingerprints are one
class; a null id takes part but never names a component unless no other does;
an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.llm.common import drop, fresh, save, small

BITS, RADIUS, WIDTH, SEED = 64, 2, 3, 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.dtype(">u8"))
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = hashes[k : k + CHUNK]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp): one row per row of docs."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def batches(it):
        for batch in it:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], schema.names)

    return docs.select(id_col, text_col).mapInArrow(batches, schema)


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as signed words, one for each table."""
    top = (1 << (radius + 1)) - 1
    phi = [1 + i % top for i in range(BITS)]
    words = [sum(1 << i for i in range(BITS) if (phi[i] & v).bit_count() % 2) for v in range(1, top + 1)]
    return [_signed(w) for w in words]


def _signed(word: int) -> int:
    return word - (1 << BITS) if word >> (BITS - 1) else word


def links(fps: DataFrame) -> DataFrame:
    """(u, v) with u < v: enough links between distinct fingerprints `fp` that
    everything within RADIUS is connected, and none beyond it."""
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks())))
    rows = save(fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key"), "simhash-tables")
    buckets = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    buckets = save(buckets, "simhash-buckets")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    two = buckets.where("n = 2").where(near).select("u", "v")
    turned = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << b)) for b in range(BITS) if not (m >> b) & 1)) for m in masks()))
    # The bucket's mask stays as it is in every cell, so a cell lies within one bucket.
    members = rows.join(buckets.where("n > 2").select("t", "key"), ["t", "key"])
    cells = members.select("t", "fp", F.explode(F.element_at(turned, F.col("t") + 1)).alias("turn"))
    cells = cells.groupBy("t", F.col("fp").bitwiseXOR(F.col("turn")).alias("cell")).agg(F.collect_list("fp").alias("all"))
    stars = cells.where(F.size("all") > 1).select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u < v")
    return two.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of its component.

    Each round lets every node hook to its smallest neighbour, follows these
    hooks to their ends, and contracts the edges; every node that is not the
    smallest around it goes, so at least half of them do in each round.
    """
    edges = save(edges.where("u <> v"), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = save(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("p")).select("node", F.least("node", "p").alias("p")), "hooks")
        while True:
            ends = hooks.select(F.col("node").alias("p"), F.col("p").alias("q"))
            jumped = save(hooks.join(ends, "p").select("node", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "hooks")
            drop(hooks)
            hooks = jumped.drop("moved")
            hooks._corpusmith_path = jumped._corpusmith_path
            if jumped.where("moved").isEmpty():
                break
        to = hooks.select(F.col("node").alias("u"), F.col("p").alias("ru"))
        contracted = edges.join(to, "u").select("v", "ru").join(to.select(F.col("u").alias("v"), F.col("ru").alias("rv")), "v")
        contracted = contracted.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        contracted = save(contracted, "links")
        if labels is None:
            labels = hooks.select("node", F.col("p").alias("root"))
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("p").alias("next"))
            labels = save(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        drop(edges)
        edges = contracted
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp, component_id): one row per row of docs; component_id is the
    smallest id that links reach."""
    rows = save(fingerprints(docs, id_col, text_col, width), "simhash-fingerprints")
    classes = save(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = save(rooted, "simhash-rooted")
    merged = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(merged, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows of docs whose id names its component, columns as they are; a null id
    goes if any other id is reached. Rows that repeat an id and differ stay together."""
    marks = near_duplicates(docs, id_col, text_col, width)
    same = fresh(docs, "__id")[0]
    gone = marks.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(same)).distinct()
    return docs.join(small(save(gone, "simhash-gone")), F.col(id_col).eqNullSafe(F.col(same)), "left_anti")


def hex16(col):
    """A signed word as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
