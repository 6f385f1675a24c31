"""Benchmark decontamination by template canonicalisation, in SQL functions only.

Texts become templates: numbers, units after numbers and names turn into typed
placeholders, all other words are lower-cased and stripped of punctuation. A number
may be spelled out ("three", "twenty-five"). A name is a capitalised word; one at the
start of a sentence fits a name, but counts as a word where words are counted.

Search. Windows of WINDOW words of every text are hashed and joined with the
windows of all items: as plain words (numbers and units typed, whatever the
case) and, where they hold names, with names typed too. An item of fewer words than a window is one window of its own width.
At most 1 - SHARE of an item's windows may be missing, so the rarest few of its
windows name all documents that can hold it.

Check. A document so named is laid beside the item at every shift that a window
met. A word fits if it is equal, a number fits a number, a unit a unit, a name a
name; a window is found where all its words fit. An item is found in a document
if at least SHARE of its distinct windows are, and its slots are consistent at
one shift, in a stretch of close shifts (words put in or left out), or over all
of them: each slot value of the item is answered by one value, with up to
1 - SLOT_SHARE exceptions. Different values may have the same answer.

Of an item with fewer words than slots the units must be equal, as they are what is left
to know it by; where words and units together are fewer than the other slots (a row
of numbers), and in items of fewer words than a window, all values must be equal, but
for case: such templates fit by chance.

Defined results: a null text holds nothing; items without a word are never
found; rows are judged by their text, so a row without an id is found with a
null id, an item without one likewise, and rows that repeat an id are judged one
by one; a document with several items gives a row for each, equal rows one; "one" is a
word, not a number; a name of two words does not fit one of one word, which costs
the windows over it; an item of one word is found wherever that word stands; empty
tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.llm.common import fresh, save, small

WINDOW, SHARE = 5, 0.8
#: Share of an item's slots that must be answered consistently; least words of a window with names that are none.
SLOT_SHARE, HARD = 0.9, 2
#: Shifts of an item along a text that are laid out at once.
SHIFTS = 256
#: Units that count as such after a number; numbers written as words.
UNITS = "%|km|m|cm|mm|miles?|feet|ft|inch(?:es)?|kg|g|mg|lbs?|pounds?|tons?|l|ml|liters?|litres?|hours?|hrs?|h|minutes?|mins?|seconds?|secs?|s|days?|weeks?|months?|years?|dollars?|euros?|cents?|usd|eur|mph|kmh|degrees?"
SPELLED = dict(zip("two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand".split(), [*range(2, 21), *range(30, 100, 10), 100, 1000]))
#: MARK opens a placeholder, its type and value follow; POINT stands for a separator inside a number.
MARK, POINT = "\u0001", "\u0002"
#: Not between words. The first ranges say nothing new, but are quick to look up.
INSIDE = rf"a-z0-9{MARK}{POINT}\p{{L}}\p{{N}}"


#: A spelled-out number, those that another may follow, those that may follow any, and where one ends.
_TENS, _POWERS = "|".join(w for w, n in SPELLED.items() if n >= 20), "(?:hundred|thousand)"
_SPELLED, _END = f"(?:{'|'.join(SPELLED)})", r"(?![\p{L}\p{N}])"


def _digits(text, values: bool):
    """text with spelled-out numbers in digits, those of several words as one number; all as 0 if their values do not matter."""
    start = r"(?i)(?=[efhnst])(?<![\p{L}\p{N}])"
    if not values:
        return F.regexp_replace(text, f"{start}{_SPELLED}(?:(?:(?<={_TENS})[ -]{_SPELLED}|[ -]{_POWERS}){_END})*{_END}", "0")
    text = F.regexp_replace(text, f"{start}({_TENS})[ -](?={_SPELLED}{_END})", f"$1{POINT}")
    text = F.regexp_replace(text, f"{start}({_SPELLED})[ -](?={_POWERS}{_END})", f"$1{POINT}")
    return reduce(lambda t, w: F.regexp_replace(t, f"{start}{w}{_END}", str(SPELLED[w])), SPELLED, text)


def _numbered(rows: DataFrame, values: bool) -> DataFrame:
    """rows with numbers and units of `text` as placeholders, with their values or without."""
    rows = rows.withColumn("text", _digits(F.translate("text", POINT, " "), values))
    x = F.col("text")
    number = rf"(?=[0-9])(?<![\p{{L}}\p{{N}}{POINT}])([0-9][0-9{POINT}]*)"
    n, u = (f" {MARK}n$1 ", f"{MARK}u$2 ") if values else (f" {MARK}n ", f"{MARK}u ")
    # The capital dotted I has a lower case of two characters, the second of which would part a word.
    out = F.translate(x, f"{MARK}İ", " I")
    out = F.regexp_replace(out, r"(?<=[0-9])[.,](?=[0-9])", POINT)
    out = F.regexp_replace(out, rf"(?i){number}[ ]?({UNITS})(?![\p{{L}}\p{{N}}])", n + u)
    out = F.regexp_replace(out, number, n)
    return rows.withColumn("text", F.when(x.rlike(f"[0-9{MARK}İ]"), out).otherwise(x))


def _split(text):
    return F.split(F.lower(text), f"[^{INSIDE}]+")


def scanned(rows: DataFrame, named: bool) -> DataFrame:
    """rows with `plain` and, if asked for, `named`, the words of `text`; a blank may stand at either end."""
    rows = _numbered(rows, False)
    rows = rows.withColumn("plain", _split(F.col("text")))
    return rows.withColumn("named", _split(F.regexp_replace("text", r"\p{Lu}\p{L}*", f"{MARK}p")) if named else F.lit(None)).drop("text")


def typed(rows: DataFrame) -> DataFrame:
    """rows with `words`, in the same places as scanned() has them: (v, k), value and kind: n, u, p (name), c (capital at
    the start of a sentence) or none."""
    marked = F.regexp_replace("text", r"\p{Lu}\p{L}*", f"{MARK}p$0")
    marked = _split(F.regexp_replace(marked, rf"((?:^|[.!?\n])[^\p{{L}}\p{{N}}{MARK}]*){MARK}p", f"$1{MARK}c"))
    value = lambda w: F.regexp_replace(w, f"{MARK}[nupc]", "")
    kind = lambda w: F.when(F.startswith(w, F.lit(MARK)), F.substring(w, 2, 1)).otherwise("")
    return _numbered(rows, True).withColumn("words", F.transform(marked, lambda w: F.struct(value(w).alias("v"), kind(w).alias("k")))).drop("text")


def text_key(text):
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text))


def _hash(words, at, width: int, form: int):
    """The hash of a window, null beyond the words."""
    parts = [F.get(words, at + k) for k in range(width)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(*parts, F.lit(form)))


def asked(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """One row per distinct item of one word or more: item, ik (its key), words, width, free (its slots may
    differ), windows (pos, rep: the first place of an equal one, h, named, soft, hard)."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    rows = rows.withColumn("ik", F.xxhash64("item", "text"))
    rows = typed(rows.withColumn("kept", F.col("text"))).withColumnRenamed("kept", "text")
    rows = scanned(rows, True)
    rows = rows.withColumn("solid", F.filter(F.sequence(F.lit(0), F.size("plain") - 1), lambda i: F.get("plain", i) != ""))
    pick = lambda c: F.transform("solid", lambda i: F.get(c, i))
    rows = rows.select("item", "ik", *(pick(c).alias(c) for c in ("plain", "named", "words")))
    # Written down, so that what follows reads words instead of making them at each mention.
    rows = save(rows, "benchmark-words").where(F.size("plain") > 0)
    kinds = F.transform("words", lambda w: w["k"])
    number = lambda *of: F.size(F.filter(kinds, lambda k: k.isin(*of)))
    rows = rows.withColumns({"n": F.size("plain"), "wordy": number("", "c") * 2 >= F.size("plain"), "free": (F.size("plain") >= WINDOW) & (number("", "c", "u") * 2 >= F.size("plain"))})
    rows = rows.withColumn("words", F.transform("words", lambda w: F.struct(w["v"].alias("v"), F.when((w["k"] == "u") & ~F.col("wordy"), "").otherwise(w["k"]).alias("k"))))
    rows = rows.withColumn("kinds", kinds)
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - WINDOW))
    # A short item's one window has its own width, which also tells its hash apart.
    whole = reduce(lambda a, w: a.when(F.col("n") == w, _hash(F.col("plain"), F.lit(0), w, -w)), range(2, WINDOW), F.when(F.col("n") == 1, _hash(F.col("plain"), F.lit(0), 1, -1)))
    h = lambda i: F.when(F.col("n") >= WINDOW, _hash(F.col("plain"), i, WINDOW, 0)).otherwise(whole)
    seen = lambda i: F.slice("kinds", i + 1, WINDOW)
    count = lambda i, test: F.size(F.filter(seen(i), test))
    windows = F.transform(places, lambda i: F.struct(
        i.alias("pos"), h(i).alias("h"), F.when((F.col("n") >= WINDOW) & (count(i, lambda k: k.isin("p", "c")) > 0), _hash(F.col("named"), i, WINDOW, 1)).alias("named"),
        (count(i, lambda k: k.isin("p", "c")) > 0).alias("soft"), count(i, lambda k: k.isin("", "c")).alias("hard"),
    ))
    rows = rows.withColumn("windows", windows)
    hashes = F.transform("windows", lambda w: w["h"])
    rows = rows.withColumn("rep", F.transform(hashes, lambda x: (F.array_position(hashes, x) - 1).cast("int")))
    return rows.select("item", "ik", "words", F.least("n", F.lit(WINDOW)).alias("width"), "free", "windows", "rep", F.size(F.array_distinct(hashes)).alias("n_windows"), F.size(F.filter("kinds", lambda k: k != "")).alias("n_slots"))


def probes(items: DataFrame) -> DataFrame:
    """(ik, pos, h, missing): the windows by which an item may be searched, with names as they are and, where
    that leaves too few, typed too; any missing + 1 of the windows suffice."""
    missing = F.col("n_windows") - F.ceil(F.col("n_windows") * SHARE)
    rows = items.select("ik", "free", missing.cast("int").alias("missing"), "rep", F.posexplode("windows").alias("at", "w")).where(F.element_at("rep", F.col("at") + 1) == F.col("at"))
    rows = rows.select("ik", "free", "missing", "w.*")
    sure = rows.groupBy("ik").agg(F.count_if(~F.col("soft")).alias("sure"))
    rows = rows.join(sure, "ik")
    plain = ~F.col("free") | ((F.col("sure") > F.col("missing")) & ~F.col("soft"))
    masked = F.col("free") & (F.col("sure") <= F.col("missing")) & (F.col("hard") >= HARD)
    found = F.when(plain, F.array("h")).when(masked, F.array_compact(F.array("h", "named")))
    return rows.select("ik", "pos", F.explode(found).alias("h"), "missing")


def hits(docs: DataFrame, wanted: DataFrame, forms: dict[int, bool], text_col: str) -> DataFrame:
    """(key, at, h): the places of all texts where a wanted window stands. forms: which kinds of hash are wanted."""
    rows = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).select(text_key("text").alias("key"), "text")
    rows = scanned(rows, forms[1])
    least = 1 if any(forms[-w] for w in range(1, WINDOW)) else WINDOW
    # An outer explode: a plain one would have the words made once more, to see whether there are any.
    rows = rows.select("key", "plain", "named", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("plain") - least))).alias("at"))
    columns = {"h0": _hash(F.col("plain"), F.col("at"), WINDOW, 0)}
    if forms[1]:
        columns["h1"] = F.when(F.array_contains(F.array(*(F.get("named", F.col("at") + k) == f"{MARK}p" for k in range(WINDOW))), True), _hash(F.col("named"), F.col("at"), WINDOW, 1))
    columns |= {f"s{w}": _hash(F.col("plain"), F.col("at"), w, -w) for w in range(1, WINDOW) if forms[-w]}
    rows = rows.select("key", "at", *(x.alias(c) for c, x in columns.items()))
    if len(columns) > 1:
        rows = rows.select("key", "at", F.explode(F.array(*columns)).alias("h")).where("h is not null")
    return rows.withColumnRenamed("h0", "h").join(wanted, "h", "left_semi").select("key", "at", "h")


def laid(pairs: DataFrame, items: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, ik, shift, wins, slots): the windows found at each shift of pairs (key, ik, shifts), by their first
    equal, and the slots under them: (a, b), the item's value and the text's."""
    rows = pairs.join(texts.withColumnRenamed("words", "there"), "key").join(small(items.select("ik", "words", "width", "free", "rep")), "ik")
    some = F.transform(F.sequence(F.lit(0), F.floor((F.size("shifts") - 1) / SHIFTS).cast("int")), lambda c: F.slice("shifts", c * SHIFTS + 1, SHIFTS))
    rows = rows.select("key", "ik", "words", "there", "width", "free", "rep", F.explode(some).alias("some"))
    # Only the words under an item go on with its shift, not the whole text.
    beside = F.transform("some", lambda s: F.struct(s.alias("shift"), F.transform("words", lambda t, i: F.get("there", s + i)).alias("here")))
    rows = rows.select("key", "ik", "words", "width", "free", "rep", F.explode(beside).alias("x")).select("key", "ik", "words", "width", "free", "rep", "x.*")
    name = lambda k: k.isin("p", "c")
    alike = lambda t, d: (name(t["k"]) & name(d["k"])) | ((t["k"] == d["k"]) & t["k"].isin("n", "u"))
    fits = F.zip_with("words", "here", lambda t, d: F.coalesce((t["v"] == d["v"]) | (F.col("free") & alike(t, d)), F.lit(False)))
    rows = rows.withColumn("fits", fits)
    rows = rows.withColumn("won", F.transform("rep", lambda r, j: F.forall(F.slice("fits", j + 1, F.col("width")), lambda x: x)))
    rows = rows.where(F.exists("won", lambda x: x))
    under = lambda i: F.exists(F.slice("won", F.greatest(i - F.col("width") + 2, F.lit(1)), F.least(F.col("width"), i + 1)), lambda x: x)
    slots = F.transform("words", lambda t, i: F.when((t["k"] != "") & under(i), F.struct(t["v"].alias("a"), F.get("here", i)["v"].alias("b"))))
    wins = F.array_distinct(F.filter(F.transform("rep", lambda r, j: F.when(F.get("won", j), r)), lambda x: x.isNotNull()))
    return rows.select("key", "ik", "shift", wins.alias("wins"), F.filter(slots, lambda x: x.isNotNull()).alias("slots"))


def judged(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(key, ik, n_windows, n_found, n_slots) of what is found, from laid()."""
    pair = ["key", "ik"]
    rows = rows.join(small(items.select("ik", "n_windows", "n_slots")), "ik")
    slack = F.greatest(F.lit(1), F.floor(F.col("n_windows") * (1 - SHARE)))
    order = Window.partitionBy(*pair).orderBy("shift")
    rows = rows.withColumn("starts", F.coalesce((F.col("shift") - F.lag("shift").over(order) > slack).cast("int"), F.lit(1)))
    rows = rows.withColumn("stretch", F.sum("starts").over(order))
    # The slots may agree at one shift, over a stretch of close ones, or over all.
    levels = (F.col("shift").cast("long"), F.col("stretch"), F.lit(0).cast("long"))
    scope = F.explode(F.array(*(F.struct(F.lit(how).alias("how"), at.alias("at")) for how, at in enumerate(levels)))).alias("x")
    rows = save(rows.select(*pair, "n_windows", "n_slots", "wins", "slots", scope).select(*pair, "n_windows", "n_slots", "wins", "slots", "x.*"), "laid-windows")
    by = [*pair, "how", "at"]
    wins = rows.select(*by, "n_windows", "n_slots", F.explode("wins").alias("w")).groupBy(*by).agg(F.countDistinct("w").alias("n"), F.first("n_windows").alias("n_windows"), F.first("n_slots").alias("n_slots"))
    full = wins.where(F.col("n") >= F.col("n_windows") * SHARE)
    answers = rows.select(*by, F.explode("slots").alias("s")).select(*by, "s.*").groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    firm = answers.groupBy(*by, "a").agg(F.max("n").alias("good"), F.sum("n").alias("all")).groupBy(*by).agg(F.sum("good").alias("good"), F.sum("all").alias("all"))
    sound = full.join(firm, by, "left").where(F.col("good").isNull() | (F.col("good") >= F.col("all") * SLOT_SHARE))
    sound = sound.select(*pair).distinct()
    return full.where("how = 2").join(sound, pair, "left_semi").select(*pair, "n_windows", F.col("n").alias("n_found"), "n_slots")


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is found (key, ik, ...), the documents in question (id, key, text), and the items."""
    known = save(asked(items, item_col, item_text_col), "benchmark-items")
    tried = save(probes(known), "benchmark-probes")
    first = known.select("ik", "free", "rep", F.posexplode("windows").alias("pos", "w")).where(F.element_at("rep", F.col("pos") + 1) == F.col("pos"))
    both = first.select("ik", "pos", F.explode(F.array_compact(F.array("w.h", F.when(F.col("free"), F.col("w.named"))))).alias("h"))
    places = save(both, "benchmark-windows")
    widths = {r.width for r in known.select("width").distinct().collect()}
    forms = {-w: w in widths for w in range(1, WINDOW)} | {1: not first.where("free and w.named is not null").isEmpty()}
    met = save(hits(docs, small(save(places.select("h").distinct(), "benchmark-hashes")), forms, text_col), "window-hits")
    # Of the windows that may be missing and one more, the rarest; any of them names a document.
    often = met.groupBy("h").agg(F.count("*").alias("often"))
    rare = Window.partitionBy("ik").orderBy("often", "pos")
    ranked = tried.join(often, "h", "left").groupBy("ik", "pos", "missing").agg(F.coalesce(F.sum("often"), F.lit(0)).alias("often"), F.collect_list("h").alias("hs"))
    ranked = ranked.withColumn("place", F.row_number().over(rare)).where(F.col("place") <= F.col("missing") + 1).where("often > 0")
    ranked = ranked.select("ik", F.explode("hs").alias("h")).distinct()
    pairs = save(met.join(small(save(ranked, "benchmark-rarest")), "h").select("key", "ik").distinct(), "window-pairs")
    shifts = pairs.join(small(places), "ik").join(met, ["key", "h"]).groupBy("key", "ik").agg(F.collect_set(F.col("at") - F.col("pos")).alias("shifts"))
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", text_key("text"))
    there = save(named.join(small(pairs.select("key").distinct()), "key", "left_semi"), "window-texts")
    texts = typed(there.groupBy("key").agg(F.first("text").alias("text")))
    return save(judged(laid(shifts, known, texts), known), "leaks"), there, known


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, n_slots): one row per document and item found in it."""
    found, there, known = _found(docs, items, id_col, text_col, item_col, item_text_col)
    rows = there.select("id", "key").distinct().join(small(found), "key").join(small(known.select("ik", "item")), "ik")
    rows = rows.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(F.max_by(F.struct("n_windows", "n_found", "n_slots"), F.struct("n_found", "n_windows")).alias("x"))
    return rows.select(id_col, item_col, "x.*")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs in whose text no item is found, columns as they are."""
    found = _found(docs, items, id_col, text_col, "item_id", "text")[0]
    key = fresh(docs, "__key")[0]
    gone = save(found.select(F.col("key").alias(key)).distinct(), "leak-keys")
    return docs.join(small(gone), text_key(F.col(text_col)) == F.col(key), "left_anti")
