"""Concepts of chunks: mentions of a catalogue's names, links with their confidence, and ids by name.

Names are looked up as substrings of small letters, all at once: an automaton of the
catalogue goes over each text one time, however many names it has. A catalogue is
sent to the tasks in parts of at most PART_BYTES, one pass over the texts for each.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions import text as tx
from corpusmith.scratch import save

#: Bytes of names that are sent to the tasks at once; letters that a name must have.
PART_BYTES, LEAST = 8_000_000, 3
#: The confidence of the innermost heading or the document, of outer headings, of a mention, of a link in the text.
INNER, OUTER, MENTION, WIKI = 1.0, 0.8, 0.75, 0.7
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
#: Fixed value: the name space of URLs, of which ids are made.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name) -> Column:
    """The name-based UUID (version 5) of a name in the name space of URLs, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def concept_uuid(collection, name) -> Column:
    return name_uuid(F.concat_ws(":", F.lit("concept"), collection.cast("string"), F.lower(name)))


def edge_uuid(collection, source, target, relation) -> Column:
    """source, target: ids of concepts."""
    return name_uuid(F.concat_ws(":", F.lit("edge"), collection.cast("string"), source, target, relation))


def catalogue(names: DataFrame) -> DataFrame:
    """(low, name): the usable names of a catalogue (name), one spelling for each in small letters."""
    clean = names.select(tx.concept_name(F.col("name")).alias("name")).where(F.length("name") >= LEAST)
    return clean.groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name"))


def _finder(sent):
    def batches(it):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in sent.value:
            automaton.add_word(name, name)
        if sent.value:
            automaton.make_automaton()
        for batch in it:
            found = [(i, n) for i, text in enumerate(batch.column(1).to_pylist()) if text and sent.value for n in {n for _, n in automaton.iter(text)}]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([n for _, n in found], pa.string())], ["chunk_id", "low"])

    return batches


def mentions(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(chunk_id, name): which names of a catalogue (name) stand anywhere in a chunk (chunk_id, content), whatever the case."""
    known = save(catalogue(names), "catalogue")
    size = known.agg(F.sum(F.octet_length("low"))).first()[0] or 0
    parts = max(1, math.ceil(size / PART_BYTES))
    texts = chunks.select("chunk_id", F.lower("content").alias("content"))
    schema = f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, low string"
    found = []
    for p in range(parts):
        part = known.where(F.pmod(F.xxhash64("low"), F.lit(parts)) == p).select("low")
        sent = chunks.sparkSession.sparkContext.broadcast([r.low for r in part.collect()])
        here = texts.mapInArrow(_finder(sent), schema)
        found.append(here if parts == 1 else save(here, "mentions"))
    return reduce(DataFrame.unionByName, found).join(known, "low").select("chunk_id", "name")


def links(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(chunk_id, concept, confidence) of chunks (chunk_id, content, hierarchy array<string>, root): the headings a chunk stands
    under (the document where there is none), links in its text, and the catalogue's names it mentions. A concept is linked once
    to a chunk, whatever the case: by the first of these ways."""
    heads = chunks.select("chunk_id", F.size("hierarchy").alias("n"), F.posexplode("hierarchy").alias("at", "name"))
    heads = heads.select("chunk_id", F.lit(0).alias("way"), "at", "name", F.when(F.col("at") == F.col("n") - 1, INNER).otherwise(OUTER).alias("confidence"))
    alone = chunks.where(F.coalesce(F.size("hierarchy"), F.lit(0)) <= 0).select("chunk_id", F.lit(0), F.lit(0), "root", F.lit(INNER))
    wiki = chunks.select("chunk_id", F.lit(1), F.posexplode(F.regexp_extract_all("content", F.lit(WIKILINK), 1)).alias("at", "name"), F.lit(WIKI))
    said = mentions(chunks, names).join(chunks.select("chunk_id", "root"), "chunk_id")
    said = said.where(~F.lower("name").eqNullSafe(F.lower("root"))).select("chunk_id", F.lit(2), F.lit(0), "name", F.lit(MENTION))
    rows = heads.union(alone).union(wiki).union(said).withColumn("name", tx.concept_name(F.col("name"))).where("name <> ''")
    first = Window.partitionBy("chunk_id", F.lower("name")).orderBy("way", "at", "name")
    return rows.withColumn("place", F.row_number().over(first)).where("place = 1").select("chunk_id", F.col("name").alias("concept"), "confidence")


def attach(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, concept, confidence) of claims (document, order, concept, confidence, version) about the chunk at a place
    of a document (chunk_id, document, order); the latest of one chunk and concept counts, claims about no chunk are none."""
    found = claims.join(chunks.select("chunk_id", "document", "order"), ["document", "order"])
    return found.groupBy("chunk_id", "concept").agg(F.max_by("confidence", "version").alias("confidence"))
