"""English word stems by Porter's second algorithm, over Arrow columns.

A batch's words are stemmed once each, however often they stand in it, and a worker
remembers the latest.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Words that English full-text search leaves out.
STOP = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
don should now""".split()

#: Fixed values of the published algorithm: whole words with stems of their own, words that step 1a leaves as they are, suffixes by step.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {"ization": "ize", "ational": "ate", "ousness": "ous", "iveness": "ive", "fulness": "ful", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "fulli": "ful", "ousli": "ous", "iviti": "ive", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _by_end(*suffixes: str) -> dict[str, list[str]]:
    """Suffixes by their last letter, longest first: most words end in none, which one look tells."""
    return {c: sorted((s for s in suffixes if s[-1] == c), key=len, reverse=True) for c in {s[-1] for s in suffixes}}


PAST, ENDS2, ENDS3, ENDS4 = _by_end("eedly", "eed", "ingly", "edly", "ing", "ed"), _by_end(*STEP2, "ogi", "li"), _by_end(*STEP3, "ative"), _by_end(*STEP4, "ion")
VOWEL, DOUBLE = "aeiouy", re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
REGION = re.compile(r"[aeiouy][^aeiouy]")
SOUND, OWNED = re.compile("[aeiouy]"), re.compile(r"'s'$|'s$|'$")
CONSONANT = re.compile(r"(?:^y|(?<=[aeiouy])y)")


def _regions(word: str) -> tuple[int, int]:
    """Where the parts behind the first and the second vowel and consonant start."""
    if word.startswith(("gener", "commun", "arsen")):
        first = 6 if word[0] == "c" else 5
    else:
        m = REGION.search(word)
        first = m.end() if m else len(word)
    m = REGION.search(word, first)
    return first, m.end() if m else len(word)


def _longest(word: str, suffixes: dict[str, list[str]]) -> str | None:
    for suffix in suffixes.get(word[-1:], ()):
        if word.endswith(suffix):
            return suffix
    return None


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and SOUND.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    suffix = _longest(w, PAST)
    if suffix in ("eed", "eedly"):
        return w[: -len(suffix)] + "ee" if len(w) - len(suffix) >= r1 else w
    if suffix and SOUND.search(w[: -len(suffix)]):
        w = w[: -len(suffix)]
        if w.endswith(("at", "bl", "iz")):
            return w + "e"
        if DOUBLE.search(w):
            return w[:-1]
        return w + "e" if len(w) <= r1 and SHORT.search(w) else w
    return w


@functools.lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a word in small letters; words of up to two letters are their own."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    # A y that acts as a consonant is written large meanwhile.
    w = word.lstrip("'")
    if "y" in w:
        w = CONSONANT.sub("Y", w)
    r1, r2 = _regions(w)
    w = _plural(OWNED.sub("", w) if "'" in w else w)
    if w in KEPT:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    suffix = _longest(w, ENDS2)
    if suffix and len(w) - len(suffix) >= r1:
        head = w[: -len(suffix)]
        if suffix == "ogi":
            w = head + "og" if head.endswith("l") else w
        elif suffix == "li":
            w = head if head[-1:] and head[-1] in "cdeghkmnrt" else w
        else:
            w = head + STEP2[suffix]
    suffix = _longest(w, ENDS3)
    if suffix and len(w) - len(suffix) >= r1:
        if suffix != "ative":
            w = w[: -len(suffix)] + STEP3[suffix]
        elif len(w) - len(suffix) >= r2:
            w = w[: -len(suffix)]
    suffix = _longest(w, ENDS4)
    if suffix and len(w) - len(suffix) >= r2 and (suffix != "ion" or w[: -len(suffix)].endswith(("s", "t"))):
        w = w[: -len(suffix)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stems(words: pa.Array) -> pa.Array:
    coded = pc.dictionary_encode(words)
    known = pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return pc.take(known, coded.indices)


@pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """A column of stems."""
    return stems(pa.array(words, pa.string(), from_pandas=True)).to_pandas()
