"""Files to documents: format detection, parsing, salvage, rejects; retrieval test sets."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.functions import text as tx
from corpusmith.sources import office

#: Bytes handed to one Arrow output batch.
BATCH_BYTES = 4 << 20
#: Most bytes of a file; shortest run and text that salvage accepts.
MOST_BYTES, RUN, SALVAGED = 75 * 1024 * 1024, 6, 30
#: Extensions by format; first bytes, in hex, by format.
EXTENSIONS = {"md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "html": "html", "htm": "html", "csv": "csv", "pdf": "pdf", "doc": "doc", "docx": "docx", "xls": "xlsx", "xlsx": "xlsx", "ppt": "ppt", "pptx": "pptx", "odt": "odt", "ods": "ods", "odp": "odp", "rtf": "rtf", "epub": "epub"}
MAGIC = {"25504446": "pdf", "504B0304": "docx", "D0CF11E0": "doc", "7B5C727466": "rtf"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of each file under path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def detect(rows: DataFrame) -> DataFrame:
    """rows (path, content) with `format`: extension first, first bytes second, else text if it decodes."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    by_ext = F.try_element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), ext)
    head = F.hex(F.substring("content", 1, 8))
    by_magic = F.coalesce(*(F.when(F.startswith(head, F.lit(m)), F.lit(f)) for m, f in MAGIC.items()))
    plain = F.when(F.is_valid_utf8(F.col("content").cast("string")), "text").otherwise("binary_unknown")
    return rows.withColumn("format", F.coalesce(by_ext, by_magic, plain))


def printable(content):
    """Runs of printable ASCII, one a line."""
    runs = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(rf"([\x20-\x7e\t\n]{{{RUN},}})"), 1)
    return F.array_join(runs, "\n")


def csv_table(content: str) -> str:
    """A pipe table of CSV text."""
    rows = [r for r in csv.reader(io.StringIO(content)) if r]
    if not rows:
        return ""
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]])


def _read(kind: str, content: bytes, latin: bool) -> tuple[str | None, str | None, str | None]:
    """(markdown, HTML, reason) of a table or an office file: one of the three is there."""
    if kind != "csv":
        return office.read(content)
    try:
        try:
            text = content.decode()
        except UnicodeDecodeError:
            text = content.decode("latin-1" if latin else "utf-8", "replace")
        return csv_table(text), None, None
    except csv.Error as e:
        return None, None, f"Error: {e}"


def unpacked(rows: DataFrame, latin: bool) -> DataFrame:
    """rows (path, format, length, content) with the markdown or HTML of tables and office files, or the reason why there is
    none. A content that was read is not passed on; batches are cut by the bytes that are read and made."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(name, T.StringType()) for name in ("markdown", "html", "damage"))])
    kinds, target = {*office.FORMATS, "csv"}, pa.schema([("path", pa.string()), ("format", pa.string()), ("length", pa.int32()), ("content", pa.binary()), ("markdown", pa.string()), ("html", pa.string()), ("damage", pa.string())])

    def batches(frames):
        made, held = [], 0
        for batch in frames:
            for path, kind, length, content in zip(*(batch.column(k) for k in range(4))):
                kind, length, content = kind.as_py(), length.as_py(), content.as_py()
                found = (None, None, None)
                if kind in kinds and length and length <= MOST_BYTES:
                    found = _read(kind, content, latin)
                    content = content if found[2] else None
                made.append((path.as_py(), kind, length, content, *found))
                held += sum(map(len, filter(None, (content, *found)))) + 64
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), target)], schema=target)
                    made, held = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), target)], schema=target)

    return rows.mapInArrow(batches, schema)


def parse(rows: DataFrame, latin: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (path, format, text, confidence, warning) and rejects (path, reason). Office files are read by
    corpusmith.sources.office; those that are damaged, and formats without a parser here, are salvaged or rejected.
    Bytes of a text that are no UTF-8 become replacement signs, or the whole text is read as ISO-8859-1 (latin)."""
    rows = detect(rows.withColumn("length", F.length("content"))).select("path", "format", "length", "content")
    rows = unpacked(rows, latin)
    kind, text = F.col("format"), F.make_valid_utf8(F.col("content").cast("string"))
    if latin:
        text = F.when(F.is_valid_utf8(F.col("content").cast("string")), text).otherwise(F.decode("content", "ISO-8859-1"))
    whole = F.coalesce("markdown", tx.stripped(tx.html_to_markdown(F.col("html"))))
    salvaged = F.trim(printable(F.col("content")))
    body = F.when(kind.isin("markdown", "text"), text).when(kind == "html", tx.html_to_markdown(text)).otherwise(F.coalesce(whole, salvaged))
    sure = F.when(kind.isin("markdown", "text"), 1.0).when(kind == "html", 0.95).when(F.coalesce("markdown", "html").isNotNull(), 0.98).when(kind == "binary_unknown", 0.3).otherwise(0.4)
    rows = rows.select("path", "format", body.alias("text"), sure.alias("confidence"), "length", "damage")
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large").when((F.col("confidence") < 0.5) & (F.length("text") <= SALVAGED), "no text")
    rows = rows.withColumn("reason", reason)
    warning = F.when(F.col("confidence") < 0.5, F.concat(F.lit("salvaged printable text"), F.coalesce(F.concat(F.lit("; "), "damage"), F.lit(""))))
    good = rows.where("reason is null").select("path", "format", "text", "confidence", warning.alias("warning"))
    return good, rows.where("reason is not null").select("path", "reason")


def retrieval_set(spark: SparkSession, path: str, distractors: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus.jsonl, queries.jsonl and qrels.tsv: judged documents and so many others, queries, judgements."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl")
    asked = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl")
    qrels = spark.read.csv(f"{path}/qrels.tsv", sep="\t", header=True, schema="qid string, doc_id string, rel int")
    judged = qrels.select(F.col("doc_id").alias("_id")).distinct()
    rest = corpus.join(judged, "_id", "left_anti").orderBy("_id").limit(distractors)
    return corpus.join(judged, "_id", "left_semi").unionByName(rest), asked.join(qrels.select(F.col("qid").alias("_id")).distinct(), "_id", "left_semi"), qrels


def keyed_jsonl(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """JSON lines without malformed ones, the last of each key."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), order).alias("x")).select(key, "x.*")


#: Characters of a raw text; what a collection's id looks like.
MOST_CHARS, UUID = 100_000, r"^(?i)(urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


def raw_texts(rows: DataFrame) -> DataFrame:
    """rows (raw_text, collection_id, ...) with the `reason` for which one is refused, null for what is taken in: at most
    MOST_CHARS characters, some of them not blank, and no collection or a UUID."""
    text, collection = F.col("raw_text"), F.col("collection_id")
    blank = ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")
    named = F.coalesce(collection, F.lit("")) != ""
    return rows.withColumn("reason", F.when(F.length(text) > MOST_CHARS, "too long").when(blank, "blank").when(named & ~collection.rlike(UUID), "collection is no UUID"))


def uploads(rows: DataFrame) -> DataFrame:
    """rows (content, metadata, ...) with the `reason` for which a file is refused, null for what is taken in, and its
    `user_metadata`: the JSON object that came with it, {} where there is none or another kind of JSON."""
    parsed = F.try_parse_json("metadata")
    given = F.coalesce("metadata", F.lit("")) != ""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    reason = F.when(size > MOST_BYTES, "too large").when(size == 0, "empty").when(given & parsed.isNull(), "metadata is no JSON")
    is_object = given & F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    return rows.withColumns({"reason": reason, "user_metadata": F.when(is_object, F.to_json(parsed)).otherwise("{}")})
