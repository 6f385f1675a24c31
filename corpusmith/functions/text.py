"""Text functions as native column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import functions as F

#: Tracking parameters of URLs.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "referrer", "source", "fbclid", "gclid", "mc_cid", "mc_eid"]

#: Patterns of queries that ask about relations.
RELATIONAL = [
    r"\b(depend(s|ency|encies|ent)?|depends\s+on)\b",
    r"\b(lineage|provenance|origin(s)?)\b",
    r"\b(connect(ed|ion|ions|s)?|link(ed|s)?|relations?(hip|hips)?)\b",
    r"\b(upstream|downstream|caller(s)?|callee(s)?)\b",
    r"\b(impact(s|ed)?|blast\s+radius|break(s)?\s+if)\b",
    r"\b(hierarch(y|ical)|parent|child(ren)?|subclass(es)?|superclass(es)?)\b",
    r"\b(architect(ure)?|flow|pipeline|interact(s|ion|ions)?)\b",
    r"\bhow\s+does\s+.+\s+(relate|connect|interact|affect|interface)",
    r"\b(what|who|which)\s+(uses|calls|imports|requires|references)\b",
    r"\b(between\s+.+\s+and\s+.+)\b",
    r"\b(trace|path\s+between|graph\s+of)\b",
]

#: Error classes in order, each with the alternatives of substrings that all must occur.
ERRORS = [
    ("api_timeout", [["timeout"], ["timed out"]]),
    ("rate_limit", [["429"], ["rate limit"]]),
    ("context_overflow", [["422", "string should have at most"]]),
    ("http_error", [["http"], ["client error"], ["server error"]]),
    ("malformed_response", [["json"], ["malformed"]]),
    ("evaluator_parse_failure", [["parse"], ["eval_failed"]]),
    ("missing_fields", [["missing"]]),
]

#: Phrases of an answer that abstains.
ABSTENTIONS = ["could not find sufficient", "no matching knowledge", "insufficient"]

#: Weights of the quality inputs, the penalty last.
QUALITY_WEIGHTS = {"extraction": 0.25, "clean": 0.15, "header": 0.10, "code": 0.15, "token": 0.15, "layout": 0.10, "table": 0.10}


def tokens(text):
    """Lower-cased runs of letters and digits. The first ranges add nothing, but are quick to look up."""
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9\p{L}\p{N}]+"), "")


def rough_tokens(text):
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def any_pattern(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def graph_hops(query):
    return F.when(F.trim(query).rlike(any_pattern(RELATIONAL)), 1).otherwise(0)


def negative_terms(query):
    """Lower-cased terms after NOT, without, except, sans, then after a dash."""
    words = F.regexp_extract_all(query, F.lit(r"(?i)(?:^|\s+)(?:NOT|without|except|sans)\s+([A-Za-z0-9_\-]+)"), 1)
    dashes = F.regexp_extract_all(without_words(query), F.lit(r"(?:^|\s+)-([A-Za-z0-9_\-]+)"), 1)
    return F.array_distinct(F.transform(F.concat(words, dashes), lambda t: F.lower(t)))


def without_words(query):
    return F.regexp_replace(query, r"(?i)(?:^|\s+)(?:NOT|without|except|sans)\s+([A-Za-z0-9_\-]+)", " ")


def clean_query(query):
    rest = F.trim(F.regexp_replace(F.regexp_replace(without_words(query), r"(?:^|\s+)-([A-Za-z0-9_\-]+)", " "), r"\s+", " "))
    return F.when(rest == "", F.trim(query)).otherwise(rest)


def holds_any(text, terms):
    """Whether a lower-cased text holds any of the trimmed, not empty terms as a substring."""
    return F.exists(terms, lambda t: (F.trim(t) != "") & F.contains(F.lower(text), F.lower(F.trim(t))))


def html_to_markdown(html):
    """Headings, list items and line breaks of a page as markdown; scripts and styles go."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)[^>]*>", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?i)<h{level}(\s[^>]*)?>", "\n" + "#" * level + " ")
    out = F.regexp_replace(out, r"(?i)</p>|<br ?/?>|</div>|</li>", "\n")
    out = F.regexp_replace(out, r"(?i)<li(\s[^>]*)?>", "- ")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(out)


#: What heads a list of contents.
CONTENTS = ["table of contents", "contents", "toc", "index"]


def _let(value, body):
    """body(value), with value made once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _without(lines, kinds, run: str, put: int):
    """lines without the runs of kinds (a letter for each line) that a pattern finds; so many empty lines in the place of each."""
    size = lambda parts, k: F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda n, x: n + F.length(x))
    empty = F.array_repeat(F.lit(""), F.lit(put))

    def body(x):
        part = lambda g, k: F.slice(x["lines"], size(x["gaps"], k) + size(x["runs"], k) + 1, F.length(g))
        return F.flatten(F.transform(x["gaps"], lambda g, k: F.when(k > 0, F.concat(empty, part(g, k))).otherwise(part(g, k))))

    found = lambda k: F.struct(lines.alias("lines"), F.split(k, run).alias("gaps"), F.regexp_extract_all(k, F.lit(run), F.lit(0)).alias("runs"))
    return _let(kinds, lambda k: _let(found(k), body))


def _kinds(lines, letter: str, test):
    """A letter for each line: the given one where it passes the test, b where it is blank, else o."""
    return F.array_join(F.transform(lines, lambda x: F.when(test(x), letter).when(stripped(x) == "", "b").otherwise("o")), "")


def strip_toc(text):
    """Without three or more items in a row that link to anchors (blank lines between them count as theirs) and without what
    heads a list of contents."""
    item = lambda x: x.rlike(r"^[ \t]*([*-]|[0-9]+[.])\s*\[[^\n]+\]\(#[^\n]+\)\s*$")
    head = lambda x: x.rlike(r"^#{1,4}\s") & F.lower(stripped(F.ltrim(x, F.lit("#")))).isin(CONTENTS)
    # An item is a line of its own: what ends the text without a line break is none.
    kinds = lambda lines: F.concat(_kinds(F.slice(lines, 1, F.size(lines) - 1), "i", item), F.lit("o"))
    left = _let(F.split(text, "\n"), lambda lines: _without(lines, kinds(lines), "i(?=b*ib*i)[ib]*", 1))
    left = _let(left, lambda lines: _without(lines, _kinds(lines, "h", head), "hb*", 0))
    return F.when(F.contains(text, F.lit("#")), stripped(F.array_join(left, "\n"))).otherwise(stripped(text))


def _recoded(part):
    """A part of a query string, decoded and encoded again."""
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(part), part)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_url(url):
    """A URL with its scheme in small letters, without tracking parameters, blank ones and an empty fragment, the others
    encoded anew, those of one name together where the first of them stood; a relative one stays."""
    scheme, rest, query, tail = (F.regexp_extract(url, pattern, 1) for pattern in (r"^([^:/?#]*)", r"^[^:/?#]*([^?#]*)", r"^[^?#]*\?([^#]*)", r"(#.+)$"))
    name, value = (lambda p: F.regexp_extract(p, "^([^=]*)=", 1)), (lambda p: F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: value(p) != ""), lambda p: F.struct(_recoded(name(p)).alias("name"), _recoded(value(p)).alias("value")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["name"]).isin(TRACKING))
    names = lambda k: F.array_distinct(F.transform(k, lambda p: p["name"]))
    grouped = _let(kept, lambda k: F.flatten(F.transform(names(k), lambda n: F.filter(k, lambda p: p["name"] == n))))
    again = F.array_join(F.transform(grouped, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    cleaned = F.concat(F.lower(scheme), rest, F.when(again != "", F.concat(F.lit("?"), again)).otherwise(""), tail)
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), cleaned).otherwise(url)


LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def clean_links(text):
    """Markdown with the targets of its links cleaned."""
    names, urls = (F.regexp_extract_all(text, F.lit(LINK), k) for k in (1, 2))
    links = F.zip_with(names, urls, lambda n, u: F.concat(F.lit("["), n, F.lit("]("), clean_url(u), F.lit(")")))
    # As many links as gaps between the parts; the last part has none behind it.
    return F.array_join(F.zip_with(F.split(text, LINK), links, lambda part, link: F.concat(part, F.coalesce(link, F.lit("")))), "")


def _ascii_forms() -> tuple[tuple[str, str], dict[str, str]]:
    """Characters whose compatibility form has one ASCII character, and these; and those whose form has several."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0x80, 0xFFFF) if not 0xD800 <= c < 0xE000]
    single = [(c, a) for c, a in pairs if len(a) == 1]
    return ("".join(c for c, _ in single), "".join(a for _, a in single)), {c: a for c, a in pairs if len(a) > 1}


FOLDED, SPREAD = _ascii_forms()


def ascii_only(text):
    """Characters in their ASCII form, of one character or several; what has none goes."""
    # A map of one literal; it is looked up in texts alone that hold one of its characters.
    forms = F.str_to_map(F.lit("\x01".join(f"{c}\x02{a}" for c, a in SPREAD.items())), F.lit("\x01"), F.lit("\x02"))
    spread = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(forms, c), c)), "")
    spread = F.when(text.rlike(f"[{''.join(map(re.escape, SPREAD))}]"), spread).otherwise(text)
    plain = F.regexp_replace(F.translate(spread, *FOLDED), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)


def canonical_id(value):
    """Ids in one spelling: what they are made of, in small ASCII letters and joined by dashes, without the kind before it."""
    low = F.lower(stripped(ascii_only(F.coalesce(value, F.lit("")))))
    bare = F.regexp_replace(low, r"^(?:doc(?:ument)?[_:\-\s]+)?(?:chunk[_:\-\s]+)?", "")
    pieces = F.split(F.regexp_replace(bare, r"[^a-z0-9#._\-\s/|:]", ""), r"[\s/|:\-]+")
    return F.regexp_replace(F.array_join(F.array_remove(pieces, ""), "-"), r"^[-_.]+|[-_.]+$", "")


def stripped(text):
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: What a context sheds in turn: rules of one kind of sign, heads of headings (set in by three blanks at most), signs of quotes.
RULES, HEADS, QUOTES = r"(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$", r"(?m)^\s{0,3}#{1,6}\s+", r"(?m)^\s*>\s?"


def fingerprint(text):
    """Its words in small letters."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")))


def distinct_sentences(text):
    """A context in plain sentences, the first of those alike in their words."""
    plain = F.regexp_replace(F.regexp_replace(text, RULES, ""), LINK, "$1 ($2)")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, HEADS, ""), QUOTES, ""), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    sentences = F.split(F.regexp_replace(stripped(plain), r"([.!?])\s+", "$1\x01"), "\x01")
    marked = F.array_sort(F.transform(sentences, lambda x, i: F.struct(fingerprint(x).alias("words"), i.alias("at"), x.alias("text"))))
    # Sorted by words, each is alike to the one before it or the first of its kind.
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(marked, lambda x: x["words"]))
    pairs = F.zip_with(marked, before, lambda x, w: F.when((x["words"] == "") | w.isNull() | (x["words"] != w), F.struct(x["at"].alias("at"), stripped(x["text"]).alias("text"))))
    kept = F.array_sort(F.filter(pairs, lambda x: x.isNotNull() & (x["text"] != "")))
    return F.array_join(F.transform(kept, lambda x: x["text"]), " ")


def cut_context(text, most):
    """A text of at most so many characters, and an ellipsis where it was longer; cut at
    the last blank if that is in the last third or so."""
    cut = F.regexp_replace(F.substring(text, F.lit(1), most), r"\s+$", "")
    head = F.regexp_extract(cut, r"(?s)^(.*[ \n])", 1)
    short = F.when(F.length(head) - 1 > most * 0.65, F.regexp_replace(head, r"\s+$", "")).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(short, F.lit("...")))


def concept_name(name):
    """Without leading numbering or markup and trailing markup; the trimmed name where nothing is left."""
    out = F.trim(F.regexp_replace(name, r"^[0-9.\-\s]+|^[#*_`\s]+|[#*_`\s]+$", ""))
    return F.when(out == "", F.trim(name)).otherwise(out)


def sanitize_query(query, most: int = 200):
    out = F.regexp_replace(F.trim(F.coalesce(query, F.lit(""))), r"[`{}\[\]<>|\\]+", " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(F.length(out) > most, F.concat(F.rtrim(F.substring(out, 1, most - 3)), F.lit("..."))).otherwise(out)


def error_class(text):
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit("invalid_benchmark_row")
    for name, ways in reversed(ERRORS):
        hit = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.contains(low, F.lit(s)) for s in way)) for way in ways))
        found = F.when(hit, name).otherwise(found)
    return found


def has_citation(answer):
    return F.coalesce(answer, F.lit("")).rlike(r"\[\d+\]")


def abstains(answer):
    low = F.lower(F.coalesce(answer, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in ABSTENTIONS))


def extraction_confidence(text):
    """0.5 for next to nothing, else 0.7 and a tenth each for headings, more than five lines, and code."""
    lines = F.filter(F.split(text, "\r\n|\n|\r"), lambda x: F.trim(x) != "")
    score = F.lit(0.7) + sum(F.when(c, 0.1).otherwise(0.0) for c in (F.exists(lines, lambda x: F.startswith(x, F.lit("#"))), F.size(lines) > 5, F.contains(text, F.lit("```"))))
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 50, 0.5).otherwise(F.least(F.lit(1.0), F.round(score, 2)))


def quality_score(inputs: dict, ocr=None):
    """The weighted mean of the quality inputs less a tenth of the OCR rate, within 0 and 1."""
    total = sum(F.lit(w) * inputs[k] for k, w in QUALITY_WEIGHTS.items()) - 0.1 * (F.lit(0.0) if ocr is None else ocr)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def chunk_quality(content, n_tokens, confidence: float = 1.0, least: int = 50, most: int = 480):
    one = F.lit(1.0)
    return quality_score({
        "extraction": F.lit(confidence), "clean": one, "header": F.lit(0.9), "layout": one, "table": one,
        "code": F.when(F.contains(content, F.lit("```")), 1.0).otherwise(0.9), "token": F.when(n_tokens.between(least, most), 1.0).otherwise(0.7),
    })


def chunk_id(doc_id, order, content):
    return F.sha2(F.concat_ws(":", doc_id.cast("string"), order.cast("string"), F.sha2(content, 256)), 256)


def json_text(raw):
    """The object inside an answer: fences off, first brace to last."""
    return F.nullif(F.regexp_extract(F.regexp_replace(raw, r"(?i)```(?:json)?", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def repaired_json(raw):
    """json_text with line breaks and trailing commas mended."""
    return F.regexp_replace(F.regexp_replace(json_text(raw), r"[\n\t]", " "), r",\s*([}\]])", "$1")


def vector_literal(vector):
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))
