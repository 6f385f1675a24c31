"""Quality classifier: random Fourier features over document statistics.

Every whole text gives a row of statistics (STATISTICS). Standardised, they pass
through random Fourier features, whose inner products approximate a Gaussian
kernel; the plain statistics and a constant stand beside them. Ridge scores come
from normal equations that each partition sums for itself. The scores of
labelled rows kept out of that fit are binned, isotonic regression turns bins
into chances, and chances are interpolated between the centres of its steps.

The fit reads at most FIT_ROWS labelled rows, drawn by a hash of the id; rows,
statistics and scores of all documents are computed whatever their number.

Defined results: a null text counts as empty and gets the score of an empty
one; rows without labels are scored alike; several labels of one id count one
by one, null labels not at all; labels of one class only, or none, give that
class's chance, or 0.5, to all; an empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmith.llm.common import crc32_of_id, draw, fresh, save, small

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digits", "punctuation", "symbols", "bangs",
    "bars", "blanks", "breaks", "distinct_words", "repeated_next", "top_word", "top_three_words", "log_line", "distinct_lines",
    "ended_lines", "short_words", "long_words", "capitalised", "words_with_symbols", "distinct_pairs", "log_sentence", "other",
)
#: Random features; kernel width in standard deviations; ridge; labelled rows read by the fit; share of them kept for calibration.
FEATURES, WIDTH, RIDGE, FIT_ROWS, CALIBRATION = 160, 5.0, 1e-3, 200_000, 0.25
#: Partial sums that reach the driver; score bins for calibration.
PARTIALS, BINS = 32, 400
#: Share of the raw score's squashed value in a calibrated score.
BLEND = 0.02
SEED = 7

#: Character classes of code points below CLASSED; above it letters are letters, the rest "other".
UPPER, LOWER, DIGIT, PUNCT, SYMBOL, SPACE, BREAK, OTHER, CLASSED = 0, 1, 2, 3, 4, 5, 6, 7, 0x3000


def _classes() -> np.ndarray:
    out = np.full(CLASSED + 1, OTHER, np.uint8)
    for c in range(CLASSED):
        ch = chr(c)
        if ch in "\n\r":
            out[c] = BREAK
        elif ch.isspace():
            out[c] = SPACE
        elif ch.isupper():
            out[c] = UPPER
        elif ch.isalpha():
            out[c] = LOWER
        elif ch.isdigit():
            out[c] = DIGIT
        elif ch in ".,;:!?'\"()-¿¡«»“”‘’–—…":
            out[c] = PUNCT
        elif 0x20 < c < 0x7F or 0xA0 < c < 0xC0 or 0x2010 <= c < 0x2BFF:
            out[c] = SYMBOL
    out[CLASSED] = LOWER
    return out


_CLASSES = _classes()
_ENDS = (".", "!", "?", '"', ":", ";", ")")


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of one whole text."""
    text = text or ""
    n = max(1, len(text))
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_CLASSES[np.minimum(points, CLASSED)], minlength=8) / n
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    plain = sum(map(str.isalpha, words))
    edged = sum(map(str.isalpha, (x[:-1] for x in words if x[-1:] in ".,;:!?")))
    sentences = 1 + sum(map(text.count, ".!?"))
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), kinds[UPPER], kinds[DIGIT], kinds[PUNCT], kinds[SYMBOL], text.count("!") / w,
        text.count("|") / w, kinds[SPACE], kinds[BREAK], len(counts) / w, sum(map(eq, words, words[1:])) / w, (top[0] if top else 0) / w, sum(top) / w, np.log1p(len(text) / k), len(set(lines)) / k,
        sum(x.rstrip().endswith(_ENDS) for x in lines) / k, float((lengths <= 2).mean()), float((lengths > 12).mean()), sum(map(str.istitle, words)) / w, (w - plain - edged) / w, pairs / w, np.log1p(w / sentences), kinds[OTHER],
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, stats): one row per row of docs; key stands for its text."""
    schema = T.StructType([docs.schema[id_col], T.StructField("key", T.BinaryType()), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def batches(it):
        for batch in it:
            stats = [statistics(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(stats, pa.list_(pa.float64()))], schema.names)

    return docs.select(id_col, text_key(F.col(text_col)), text_col).mapInArrow(batches, schema)


def text_key(text):
    """16 bytes that stand for a text; a null one has an empty one's."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


@dataclass
class Model:
    """Standardisation, random features, ridge weights and calibration knots."""

    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[list[float], list[float]] = ((0.0,), (0.5,))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.turns + self.shifts) * np.sqrt(2 / self.turns.shape[1])
        return np.hstack([waves, z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.knots[1][0])
        raw = self.raw(stats)
        # A little of the raw score keeps order within a step and beyond the outer knots.
        return (1 - BLEND) * np.interp(raw, *self.knots) + BLEND / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30)))


def isotonic(x: np.ndarray, hits: np.ndarray, n: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators over bins at x in rising order; knots at the steps' centres."""
    steps: list[list[float]] = []
    for at, h, c in zip(x, hits, n):
        steps.append([at * c, h, c])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last)]
    # Half an observation of either class keeps chances off 0 and 1, so that the ends still rank.
    return [s[0] / s[2] for s in steps], np.maximum.accumulate([(s[1] + 0.5) / (s[2] + 1) for s in steps]).tolist()


def fit(labelled: DataFrame) -> Model:
    """labelled: (stats, y 0/1, u) with u uniform; rows of u under CALIBRATION calibrate."""
    dims = len(STATISTICS)
    rng = np.random.default_rng(SEED)
    sums = [f(x) for i in range(dims) for x in (F.col("stats")[i],) for f in (F.sum, lambda c: F.sum(c * c))]
    train = labelled.where(F.col("u") >= CALIBRATION)
    total = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), *sums).first()
    n, hits = total[0], total[1]
    mean = np.array([(total[2 + 2 * i] or 0.0) / max(1, n) for i in range(dims)])
    square = np.array([(total[3 + 2 * i] or 0.0) / max(1, n) for i in range(dims)])
    scale = np.sqrt(np.maximum(square - mean**2, 1e-12))
    model = Model(mean, scale, rng.normal(0, 1 / WIDTH, (dims, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES))
    if not 0 < hits < n:
        share = labelled.agg(F.avg("y")).first()[0]
        model.knots = ([0.0], [0.5 if share is None else share])
        return model

    def partial(it):
        side = FEATURES + dims + 1
        gram, moment = np.zeros((side, side)), np.zeros(side)
        for batch in it:
            x = model.features(np.array(batch.column(0).to_pylist(), float).reshape(-1, dims))
            gram += x.T @ x
            moment += x.T @ batch.column(1).to_numpy().astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([np.vstack([gram, moment]).tobytes()], pa.binary())], ["sums"])

    side = FEATURES + dims + 1
    both = np.zeros((side + 1, side))
    for row in train.select("stats", "y").coalesce(PARTIALS).mapInArrow(partial, "sums binary").collect():
        both += np.frombuffer(row.sums, float).reshape(both.shape)
    ridge = np.eye(side) * RIDGE * n
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(both[:-1] + ridge, both[-1])

    def binned(it):
        for batch in it:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, dims)
            bins = np.clip(np.floor(model.raw(x) * BINS), -BINS, 2 * BINS).astype(np.int64) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "y"])

    rest = labelled.where(F.col("u") < CALIBRATION).select("stats", F.col("y").cast("long").alias("y"))
    bins = rest.mapInArrow(binned, "bin long, y long").groupBy("bin").agg(F.sum("y").alias("hits"), F.count("*").alias("n")).collect()
    if bins:
        bins = sorted((r.bin, r.hits, r.n) for r in bins)
        model.knots = isotonic(*(np.array(c, float) for c in zip(*((b / BINS + 0.5 / BINS, h, c) for b, h, c in bins))))
    else:
        model.knots = ([0.0, 1.0], [0.0, 1.0])
    return model


def classify(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted, key): one row per row of docs; key stands for its
    text. held_out: a condition on id_col; labels of rows that meet it are never read."""
    stats = save(document_statistics(docs, id_col, text_col), "quality-statistics")
    known = labels.select(id_col, F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1)).where(~held_out)
    n = known.count()
    known = save(known.where(draw(id_col, seed=SEED) < min(1.0, FIT_ROWS / max(1, n))), "quality-labels")
    labelled = save(stats.join(small(known), id_col).select("stats", "y", draw(id_col, seed=SEED + 1).alias("u")), "quality-labelled")
    model = fit(labelled)
    schema = T.StructType([stats.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("key", T.BinaryType())])

    def scored(it):
        for batch in it:
            x = np.array(batch.column(3).to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x), pa.float64()), batch.column(2)], schema.names)

    rows = stats.select(id_col, held_out.alias("held_out"), "key", "stats").mapInArrow(scored, schema)
    return rows.select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "key")


def keep_good(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose text is predicted good, columns as they are. Each row goes or stays by its own text."""
    key = fresh(docs, "__key")[0]
    bad = classify(docs, labels, held_out, id_col, text_col).where("predicted = 0").select(F.col("key").alias(key)).distinct()
    return docs.join(small(save(bad, "quality-rejects")), text_key(F.col(text_col)) == F.col(key), "left_anti")


def held_out(id_col: str, mod: int, rest: int):
    return F.coalesce(crc32_of_id(F.col(id_col)) % mod == rest, F.lit(False))
