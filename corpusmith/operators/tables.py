"""Relational operators around the corpus: deduplicating ingestion, upserts, quotas, exports."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_of(rows: DataFrame, keys: list[str], order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__place = 1").drop("__place")


def ingest_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming (collection, content_hash, ...) rows whose text the collection lacks, each once."""
    return first_of(incoming, ["collection", "content_hash"], ["doc_id"]).join(existing.select("collection", "content_hash"), ["collection", "content_hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Old and new rows, the latest version of each key."""
    return first_of(old.unionByName(new), keys, [F.desc(version)])


def written(old: DataFrame, new: DataFrame, keys: list[str], derived: dict[str, tuple[str, Column]], stamp: str, now: Column) -> DataFrame:
    """old after new rows, one a key, are inserted or, where their key is there, update the columns that new has. Columns that
    are derived (name: the column they follow, expression) are made again in rows whose source was written, and the stamp of
    every row written is now; all other rows stay as they are. What an inserted row was not given is null. Null keys match
    nothing and are inserted."""
    there = [c for c in old.columns if c not in keys]
    marked = old.select(*keys, *(F.col(c).alias(f"__{c}") for c in there), F.lit(True).alias("__there"))
    kept = {c: F.col(c if c in new.columns else f"__{c}") for c in there}
    kept |= {c: made if source in new.columns else F.when(F.col("__there"), F.col(f"__{c}")) for c, (source, made) in derived.items()}
    kept[stamp] = now
    rows = new.join(marked, keys, "left").select(*keys, *(x.cast(old.schema[c].dataType).alias(c) for c, x in kept.items()))
    return old.join(new.select(*keys), keys, "left_anti").unionByName(rows)


def delete_cascade(tables: dict[str, DataFrame], parents: dict[str, tuple[str, str, str]], root: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of root in gone (id) and without what hangs on them.
    parents: table -> (parent, own foreign key, parent's key), parents first."""
    lost = {root: gone.select("id")}
    out = {root: tables[root].join(gone.select("id"), "id", "left_anti")}
    for name, (parent, key, _) in parents.items():
        dead = lost[parent].select(F.col("id").alias(key))
        lost[name] = tables[name].join(dead, key, "left_semi").select("id")
        out[name] = tables[name].join(dead, key, "left_anti")
    return out


def folded(rows: DataFrame, keys: list[str], order: list[str], read: list[str], start, step: Callable, out: list[T.StructField]) -> DataFrame:
    """rows with what a fold yields at each of them: step(state, values of read) -> (state, values of out). A key's
    rows stream past in order, so that a long one needs time, but no memory."""
    schema = T.StructType([*rows.schema.fields, *out])

    def run(frames):
        last, state = None, start
        for frame in frames:
            made = []
            for key, values in zip(zip(*(frame[k] for k in keys)), zip(*(frame[c] for c in read))):
                if key != last:
                    last, state = key, start
                state, put = step(state, values)
                made.append(put)
            yield pd.concat([frame, pd.DataFrame(made, columns=[f.name for f in out], index=frame.index)], axis=1)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def admitted(tokens: np.ndarray, used: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The use after each of some requests in order, and which are let in: those that fit the limit with what was
    used before. A step for each run of refusals, not for each request."""
    gains, n = np.maximum(tokens, 0), len(tokens)
    after, fits = np.full(n, used, np.int64), np.zeros(n, bool)
    at = 0
    while at < n:
        total = used + np.cumsum(gains[at:])
        refused = np.flatnonzero(total - gains[at:] + tokens[at:] > limit) if limit > 0 else []
        stop = at + int(refused[0]) if len(refused) else n
        after[at:stop], fits[at:stop] = total[: stop - at], True
        used = int(after[stop - 1]) if stop > at else used
        # Nothing is let in until one fits what is left.
        next_fit = np.flatnonzero(used + tokens[stop:] <= limit)
        at = stop + int(next_fit[0]) if len(next_fit) else n
        after[stop:at] = used
    return after, fits


#: Requests of a group up to which all groups' k-th requests are judged at once.
SHORT = 64


def admitted_each(tokens: np.ndarray, first: np.ndarray, used: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """admitted() of many groups that stand one after another: first has where each starts, used what it used before."""
    after, fits = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    sizes, used = np.diff(np.append(first, len(tokens))), used.copy()
    for g in np.flatnonzero(sizes > SHORT):
        part = slice(first[g], first[g] + sizes[g])
        after[part], fits[part] = admitted(tokens[part], int(used[g]), limit)
    here = np.flatnonzero(sizes <= SHORT)
    for k in range(sizes[here].max() if len(here) else 0):
        here = here[sizes[here] > k]
        at = first[here] + k
        fits[at] = (used[here] + tokens[at] <= limit) | (limit <= 0)
        used[here] += np.where(fits[at], np.maximum(tokens[at], 0), 0)
        after[at] = used[here]
    return after, fits


def quota(events: DataFrame, limit: int) -> DataFrame:
    """Events (event_id, tenant, ts, tokens) with the day's use after each and whether it was let in, by days in UTC.
    What was turned away uses nothing; a limit of 0 or less lets all in; null tokens are none. A tenant's day streams
    past in order, so that a long one needs time, but no memory."""

    def run(frames):
        last, used = None, 0
        for frame in frames:
            keys = frame["tenant"].to_numpy(), frame["day"].to_numpy()
            edges = np.flatnonzero(np.any([pd.Series(k[1:]).ne(pd.Series(k[:-1])) for k in keys], axis=0)) + 1 if len(frame) else []
            tokens, outs = frame["tokens"].fillna(0).to_numpy(np.int64), []
            for a, b in zip([0, *edges], [*edges, len(frame)]):
                key = (keys[0][a], keys[1][a])
                used = used if key == last else 0
                outs.append(admitted(tokens[a:b], used, limit))
                last, used = key, int(outs[-1][0][-1])
            yield frame.assign(used=np.concatenate([o[0] for o in outs]), admitted=np.concatenate([o[1] for o in outs]))

    kind = events.schema["ts"].dataType
    # An instant's day is its day in UTC, whatever the session's zone; a time without a zone has its own.
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("ts") / 86_400).cast("int")) if isinstance(kind, T.TimestampType) else F.to_date("ts")
    rows = events.withColumn("day", day)
    schema = T.StructType([*rows.schema.fields, T.StructField("used", T.LongType()), T.StructField("admitted", T.BooleanType())])
    return rows.repartition("tenant", "day").sortWithinPartitions("tenant", "day", "ts", "event_id").mapInPandas(run, schema)


def since(rows: DataFrame, column: str, watermark) -> DataFrame:
    return rows.where(F.col(column) > F.lit(watermark))


def export_row(rows: DataFrame) -> DataFrame:
    """The export schema from chunk rows with a metadata map."""
    meta = lambda *keys: F.coalesce(*(F.nullif(F.element_at("metadata", k), F.lit("")) for k in keys))
    unknown = F.lit("unknown")
    content = F.coalesce("content", F.lit(""))
    source = F.coalesce(meta("source_name", "source"), unknown)
    return rows.select(
        F.col("chunk_id").cast("string").alias("chunk_id"), source.alias("source"), F.coalesce(meta("source_url"), F.lit("")).alias("source_url"),
        F.coalesce(meta("upstream_license", "license", "license_name"), unknown).alias("upstream_license"), F.coalesce(F.col("document_id").cast("string"), meta("doc_id"), F.lit("")).alias("document_id"),
        F.coalesce("chunk_order", F.lit(0)).alias("chunk_index"), F.coalesce(meta("retrieved_at"), F.lit("")).alias("retrieved_at"),
        F.coalesce(meta("chunker_version", "version"), F.lit("spark-export-v1")).alias("chunker_version"), F.when(content == "", F.col("chunk_id").cast("string")).otherwise(F.sha2(content, 256)).alias("content_hash"),
        content.alias("content"), F.coalesce(meta("namespace"), unknown).alias("namespace"), source.alias("source_name"), content.alias("raw_text"), content.alias("cleaned_text"),
        F.array_join(F.split(F.coalesce(meta("tags"), F.lit("")), r"\s*,\s*"), ", ").alias("tags"), F.coalesce("collection", meta("collection_name"), F.lit("")).alias("collection_name"),
    )


def valid_rows(rows: DataFrame) -> DataFrame:
    """Generation rows (answer, has_text, n_ids, n_distinct: ids that are not blank) with `valid`."""
    answer = F.trim(F.coalesce("answer", F.lit("")))
    repeats = 1.0 - F.col("n_distinct") / F.col("n_ids")
    ok = (F.length(answer) >= 30) & F.col("has_text") & (F.col("n_ids") > 0) & ~F.endswith(answer, F.lit("..."))
    return rows.withColumn("valid", F.coalesce(ok & (F.when(F.col("n_ids") > 0, repeats).otherwise(0.0) <= 0.6), F.lit(False)))


def quality_gate(rows: DataFrame) -> DataFrame:
    """PASS if under a tenth of rows failed and at least 95 % were evaluated. rows: (failed, evaluated)."""
    r = rows.agg(F.avg(F.col("failed").cast("int")).alias("error_rate"), F.avg(F.col("evaluated").cast("int")).alias("coverage"))
    return r.withColumn("verdict", F.when((F.col("error_rate") < 0.10) & (F.col("coverage") >= 0.95), "PASS").otherwise("FAIL"))


def audit(datasets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Datasets (name) classed safe, blocked, mixed or unknown by a manifest (pattern glob, redistributable string)."""
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+^$(){}|\[\]])", r"\\$1"), r"\*", ".*"), r"\?", ".")
    rules = F.broadcast(manifest.select(F.concat(F.lit("^"), pattern, F.lit("$")).alias("rule"), "redistributable"))
    kind = F.when(F.col("redistributable") == "true", "safe").when(F.col("redistributable") == "mixed", "mixed").otherwise("blocked")
    rows = datasets.join(rules, F.expr("name rlike rule"), "left").groupBy("name").agg(F.min(F.when(F.col("rule").isNotNull(), kind)).alias("class"))
    return rows.fillna("unknown", ["class"])
