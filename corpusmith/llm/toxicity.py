"""Toxicity by a weighted finite-state pattern grammar.

Lexicon. Words and word stems (prefixes) are counted in labelled documents. A
unit is an insult if the share of toxic documents among those that hold it
surprises beyond what testing all units explains, and if no single preceding
word accounts for most of its toxic uses (else it merely comes along in copies
of one text). Its weight is its log-odds. Seed insults have a fixed weight until
enough labelled documents confirm or contradict them; fixed seed words give
threats, targets, negations and reported speech.

Grammar. The lexicon is one finite automaton that runs over the whole text. Each
clause with a match then runs through the composition of five weighted
transducers: insult and threat (let the weights of their own words through, on
a tape each), negation (turns the weights of the next tokens down), reported
speech (turns down the rest of the clause) and target (whose final weight turns
the clause up, and lets threats through only where someone is meant). The result
is a weight for each matched clause; documents are scored by a logistic
regression on their clauses, never on isolated words.

The fit reads at most FIT_ROWS labelled rows, drawn by a hash of the id; all
texts are scored whole.

Words are runs of letters, two or more, of any length; a script without spaces
is learned by whole runs only.

Defined results: a null text counts as empty and scores as a text without a
match; an id with labels of both kinds is toxic, null labels count not at all;
without labels of both classes every score is that class's chance, or 0; an empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.llm.common import draw, save, small

#: Labelled rows that the fit reads; lengths of stems; share of one preceding word beyond which a unit is a passenger; least odds ratio.
FIT_ROWS, STEMS, PASSENGER, ODDS = 30_000, (5, 6, 7), 0.4, 6.0
#: Factors: negated, reported, aimed at a target; weight of a threat; tokens that a negation reaches.
NEGATED, REPORTED, AIMED, THREAT_WEIGHT, REACH = 0.4, 0.6, 1.3, 2.0, 3
#: Partitions of the fit; folds by which lexicon and clause weights are fitted crosswise.
TRAIN_PARTITIONS, FOLDS, SEED = 24, 3, 11

#: Seed words. An insult's weight until labelled documents say otherwise, and the documents that can say so.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb trottel dummkopf crétin imbécile estúpido imbécil"
INSULT_WEIGHT, EVIDENCE = 3.0, 5
THREATS = "kill murder hurt destroy stab shoot strangle töten umbringen tuer frapper matar"
TARGETS = "you your yourself he she they them him her people du dich dein ihr euch sie tu toi vous ton il elle ils tú usted ustedes ellos"
NEGATIONS = "not never no isn't aren't wasn't don't nicht kein keine nie pas jamais ne nunca"
REPORTS = "said says say quoted called wrote writes claimed reported according sagte schrieb dit écrit dijo escribió"
SEEDS = {w: c for c, words in (("H", THREATS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words.split()}

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
STOP = re.compile(r"[.!?;\n]")
FEATURES = ("best", "total", "clauses", "density")


class Transducer(NamedTuple):
    """Over the word classes I, H, T, N, R, O: what follows each state, the factors put out on the insult and
    the threat tape on the way, and the factors of ending in a state."""

    states: range
    step: Callable[[int, str], int]
    out: Callable[[int, str], tuple[float, float]]
    final: Callable[[int], tuple[float, float]] = lambda s: (1.0, 1.0)


INSULT = Transducer(range(1), lambda s, c: 0, lambda s, c: (float(c == "I"), 1.0))
THREAT = Transducer(range(1), lambda s, c: 0, lambda s, c: (1.0, float(c == "H")))
NEGATION = Transducer(range(REACH + 1), lambda s, c: REACH if c == "N" else max(0, s - 1), lambda s, c: (NEGATED, NEGATED) if s else (1.0, 1.0))
REPORTING = Transducer(range(2), lambda s, c: int(s or c == "R"), lambda s, c: (REPORTED, REPORTED) if s else (1.0, 1.0))
TARGET = Transducer(range(2), lambda s, c: int(s or c == "T"), lambda s, c: (1.0, 1.0), lambda s: (AIMED, AIMED) if s else (1.0, 0.0))


def compose(parts: tuple[Transducer, ...] = (INSULT, THREAT, NEGATION, REPORTING, TARGET)) -> tuple[dict, dict, tuple]:
    """Their product: (state, class) -> (state, insult factor, threat factor); state -> final factors; the start."""
    table, final = {}, {}
    for state in itertools.product(*(p.states for p in parts)):
        ends = [p.final(s) for p, s in zip(parts, state)]
        final[state] = math.prod(e[0] for e in ends), math.prod(e[1] for e in ends)
        for c in "IHTNRO":
            outs = [p.out(s, c) for p, s in zip(parts, state)]
            after = tuple(p.step(s, c) for p, s in zip(parts, state))
            table[state, c] = after, math.prod(o[0] for o in outs), math.prod(o[1] for o in outs)
    return table, final, tuple(0 for _ in parts)


class Grammar:
    """Scores whole texts. units: (text, is a whole word, weight)."""

    def __init__(self, units: list[tuple[str, bool, float]]):
        import ahocorasick

        arcs: dict[str, list] = {}
        for text, whole, weight in units:
            arcs.setdefault(text, []).append((whole, weight, "I"))
        for text, kind in SEEDS.items():
            if kind == "H":
                arcs.setdefault(text, []).append((True, THREAT_WEIGHT, "H"))
        self.found = ahocorasick.Automaton()
        for text, kinds in arcs.items():
            self.found.add_word(text, (len(text), kinds))
        self.found.make_automaton()
        self.table, self.final, self.start = compose()

    def matches(self, text: str) -> dict[int, tuple[float, str]]:
        """Start of each matched word: its weight and class."""
        out: dict[int, tuple[float, str]] = {}
        n = len(text)
        for last, (length, kinds) in self.found.iter(text):
            at = last + 1 - length
            if at and text[at - 1].isalpha():
                continue
            ends = last + 1 == n or not text[last + 1].isalpha()
            for whole, weight, kind in kinds:
                if ends == whole:
                    out[at] = max(out.get(at, (0.0, kind)), (weight, kind))
        return out

    def clauses(self, text: str) -> list[float]:
        """Weights of the matched clauses of a lower-cased text."""
        matches = self.matches(text)
        out, until = [], 0
        for at in sorted(matches):
            if at < until:
                continue
            # The clause begins behind the last stop, which is no further back than the last clause's end.
            begin = max(until, *(text.rfind(c, until, at) + 1 for c in ".!?;\n"))
            stop = STOP.search(text, at)
            until = stop.start() if stop else len(text)
            state, insults, threats = self.start, 0.0, 0.0
            for m in WORD.finditer(text, begin, until):
                weight, kind = matches.get(m.start(), (0.0, SEEDS.get(m[0], "O")))
                state, insult, threat = self.table[state, kind]
                insults += weight * insult
                threats += weight * threat
            insult, threat = self.final[state]
            total = insults * insult + threats * threat
            if total > 0:
                out.append(total)
        return out

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        found = self.clauses(text)
        words = 1 + text.count(" ")
        return [min(10.0, max(found, default=0.0)), math.log1p(sum(found)), math.log1p(len(found)), math.log1p(200 * len(found) / words)]


def units_of(text: str) -> set[str]:
    """Whole words (marked by a full stop) and stems of a text."""
    words = {w for w in WORD.findall(text.lower()) if len(w) > 1}
    return {w + "." for w in words} | {w[:k] for w in words for k in STEMS if len(w) > k}


def surprise(toxic: float, all_: float, base: float) -> float:
    """How unlikely so many toxic documents among all are, as a negative log chance bound."""
    p = toxic / all_
    if p <= base:
        return 0.0
    return all_ * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0))


def _unit_counts(train: DataFrame) -> DataFrame:
    """(unit, n0, n1, ...): in how many texts of each fold and kind a unit stands, at 2 * fold + y; counted in one pass."""
    names = ["unit", *(f"n{k}" for k in range(2 * FOLDS))]

    def counted(it):
        counts: dict[str, list[int]] = {}
        for batch in it:
            for text, y, fold in zip(batch.column(0), batch.column(1), batch.column(2)):
                at = 2 * fold.as_py() + y.as_py()
                for u in units_of(text.as_py() or ""):
                    counts.setdefault(u, [0] * (2 * FOLDS))[at] += 1
        keys = list(counts)
        for k in range(0, len(keys), 50_000):
            part = keys[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[u][c] for u in part], pa.int64()) for c in range(2 * FOLDS))], names)

    counts = train.select("text", "y", "fold").mapInArrow(counted, "unit string, " + ", ".join(f"{n} long" for n in names[1:]))
    return save(counts.groupBy("unit").agg(*(F.sum(n).alias(n) for n in names[1:])), "toxicity-units")


def _picked(counts: DataFrame, toxic: int, clean: int) -> tuple[dict, list]:
    """Units that speak for toxic texts (unit: (toxic, clean)), and the seeds that stay. counts: (unit, toxic, clean)."""
    base, bar = toxic / (toxic + clean), math.log(max(2, counts.count())) + 1
    odds = (F.col("toxic") + 0.5) / (toxic + 1) * (clean + 1) / (F.col("clean") + 0.5)
    # Each accepted unit stands in several of the FIT_ROWS documents, which bounds their number.
    rows = counts.where((F.col("toxic") > bar / -math.log(base) / 2) & (odds >= ODDS)).collect()
    picked = {r.unit: (r.toxic, r.clean) for r in rows if surprise(r.toxic, r.toxic + r.clean, base) >= bar}
    seeds = {w + ".": None for w in INSULTS.split()}
    for r in counts.where(F.col("unit").isin(*seeds)).collect():
        seeds[r.unit] = (r.toxic + 0.5) / (toxic + 1) * (clean + 1) / (r.clean + 0.5) >= ODDS if r.toxic + r.clean >= EVIDENCE else None
    return picked, [(u.rstrip("."), True, INSULT_WEIGHT) for u, agreed in seeds.items() if agreed is not False and u not in picked]


def _befores(train: DataFrame, names: frozenset[str]) -> DataFrame:
    """(unit, before, n0, n1, ...): in how many toxic texts of each fold two words stand before a unit; counted in one pass."""
    columns = ["unit", "before", *(f"n{k}" for k in range(FOLDS))]

    def befores(it):
        counts: dict[tuple[str, str], list[int]] = {}
        for batch in it:
            for text, fold in zip(batch.column(0), batch.column(1)):
                words = ["", "", *WORD.findall((text.as_py() or "").lower())]
                # Once per document, whatever it repeats.
                for pair in {(u, f"{words[k - 2]} {words[k - 1]}") for k in range(2, len(words)) for w in (words[k],) if len(w) > 1 for u in (w + ".", *(w[:c] for c in STEMS if len(w) > c)) if u in names}:
                    counts.setdefault(pair, [0] * FOLDS)[fold.as_py()] += 1
        pairs = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), *(pa.array([counts[p][f] for p in pairs], pa.int64()) for f in range(FOLDS))], columns)

    # Two words before: 'you' alone precedes many an insult.
    pairs = train.where("y = 1").select("text", "fold").mapInArrow(befores, "unit string, before string, " + ", ".join(f"{n} long" for n in columns[2:]))
    return save(pairs.groupBy("unit", "before").agg(*(F.sum(n).alias(n) for n in columns[2:])), "toxicity-befores")


def learn_lexicons(train: DataFrame) -> dict[int, list[tuple[str, bool, float]]]:
    """The insult lexicon of each fold, learned from the other folds' texts, and at -1 that of all. A lexicon is missing
    where the texts are of one kind. train: (text, y, fold), each text once. Texts are read twice, for all lexicons together."""
    tally = {(r.fold, r.y): r["count"] for r in train.groupBy("fold", "y").count().collect()}
    counts, found = _unit_counts(train), {}
    for out in (-1, *range(FOLDS)):
        folds = [f for f in range(FOLDS) if f != out]
        clean, toxic = (sum(tally.get((f, y), 0) for f in folds) for y in (0, 1))
        if clean and toxic:
            sums = counts.select("unit", *(sum(F.col(f"n{2 * f + y}") for f in folds).alias(name) for y, name in enumerate(("clean", "toxic")))).where("clean + toxic > 0")
            found[out] = (clean, toxic, *_picked(sums, toxic, clean))
    names = frozenset(u for _, _, picked, _ in found.values() for u in picked)
    pairs = _befores(train, names) if names else None
    lexicons = {}
    for out, (clean, toxic, picked, seeded) in found.items():
        lexicons[out] = seeded
        if picked:
            rows = pairs.select("unit", sum(F.col(f"n{f}") for f in range(FOLDS) if f != out).alias("n")).where("n > 0")
            shares = rows.groupBy("unit").agg((F.max("n") / F.sum("n")).alias("share"))
            keep = {r.unit for r in shares.collect() if r.share <= PASSENGER and r.unit in picked}
            # Seeds that the labels confirm stay whatever stands before them.
            keep |= picked.keys() & {w + "." for w in INSULTS.split()}
            weigh = lambda t, c: math.log((t + 0.5) / (toxic + 1) * (clean + 1) / (c + 0.5))  # noqa: E731, B023
            lexicons[out] = sorted([(u.rstrip("."), u.endswith("."), weigh(*picked[u])) for u in keep] + seeded)
    return lexicons


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, turns: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression, the constant last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6]) * max(1, len(x)) ** 0.5
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _measured(lexicons: dict[int, list[tuple[str, bool, float]]]):
    def batches(it):
        grammars = {fold: Grammar(units) for fold, units in lexicons.items()}
        for batch in it:
            f = [grammars[fold.as_py()].features(t.as_py()) for t, fold in zip(batch.column(0), batch.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column(1)], ["f", "y"])

    return batches


def classify(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted): one row per row of docs. held_out: a
    condition on id_col; labels of rows that meet it are never read."""
    known = labels.select(id_col, F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1)).where(~held_out)
    known = known.groupBy(id_col).agg(F.max("y").alias("y"))
    n = known.count()
    known = save(known.where(draw(id_col, seed=SEED) < min(1.0, FIT_ROWS / max(1, n))), "toxicity-labels")
    train = docs.select(id_col, F.col(text_col).alias("text")).join(small(known), id_col)
    # Each text once, so that copies do not vote; a text with labels of both kinds is toxic.
    train = train.groupBy(F.xxhash64("text").alias("key")).agg(F.max("y").alias("y"), F.first("text").alias("text"))
    train = save(train.repartition(TRAIN_PARTITIONS, "key").select("text", "y", F.pmod("key", F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-train")
    tally = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
    clean, toxic = tally.get(0, 0), tally.get(1, 0)
    lexicons = learn_lexicons(train) if toxic and clean else {}
    units, weights = lexicons.get(-1, []), None
    if toxic and clean:
        # Clauses of a text count by a lexicon that has not seen the text, so that its own words do not vouch for it.
        unseen = {fold: lexicons.get(fold, units) for fold in range(FOLDS)}
        rows = train.select("text", F.col("y").cast("long").alias("y"), "fold").mapInArrow(_measured(unseen), "f array<double>, y long").toArrow()
        weights = logistic(np.array(rows.column("f").to_pylist(), float).reshape(-1, len(FEATURES)), rows.column("y").to_numpy().astype(float))
    constant = 1.0 if toxic else 0.0
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def scored(it):
        grammar = Grammar(units)
        for batch in it:
            if weights is None:
                scores = np.full(batch.num_rows, constant)
            else:
                x = np.array([grammar.features(t.as_py()) for t in batch.column(2)], float).reshape(-1, len(FEATURES))
                scores = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], schema.names)

    rows = docs.select(id_col, held_out.alias("held_out"), text_col).mapInArrow(scored, schema)
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
