"""Quality and toxicity: held-out accuracy, parts against plain versions, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmith.llm import quality, queries, toxicity


def held_out_figures(rows, labels, rest, mod):
    """Rows of (doc_id, held_out, score, predicted) against labels of held-out ids: AUC and accuracy."""
    pairs = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1
        if r.held_out and r.doc_id in labels:
            pairs.append((r.score, labels[r.doc_id], r.predicted))
    good, bad = [s for s, y, _ in pairs if y], [s for s, y, _ in pairs if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    return auc, np.mean([y == p for _, y, p in pairs])


@pytest.mark.parametrize("query,label,rest,mod,least", [(queries.op3_quality, "quality", 1, 3, 0.95), (queries.op8_toxicity, "toxic", 2, 4, 0.75)])
def test_held_out(spark, query, label, rest, mod, least):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    auc, accuracy = held_out_figures(query(spark, sf_dir).collect(), labels, rest, mod)
    assert auc >= least and accuracy >= 0.9


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 20, 50).astype(float)
    x, y = quality.isotonic(np.arange(50.0), np.floor(n * rng.random(50)), n)
    assert all(a < b for a, b in zip(x, x[1:])) and len(x) == len(y)
    assert all(a <= b for a, b in zip(y, y[1:]))
    x, y = quality.isotonic(np.arange(4.0), np.array([0.0, 1, 0, 10]), np.array([10.0, 10, 1, 10]))
    assert all(a <= b for a, b in zip(y, y[1:])) and y[0] < 0.1 and y[-1] > 0.9


def test_statistics_of_odd_texts():
    for text in (None, "", " \n ", "x", "日本" * 5, "\x00\ufffd", "word " * 20000):
        stats = quality.statistics(text)
        assert len(stats) == len(quality.STATISTICS) and np.isfinite(stats).all()


ROWS = [(1, None), (7, ""), (9, "some words, here."), (9, "some words, here."), (None, "x")]


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(2, 0), (3, 0)], 0.5), ([(9, 1), (7, 1), (1, None), (9, 1)], 1.0), ([(7, 0), (9, 0)], 0.0)])
def test_quality_without_both_classes(spark, docs, labels, score):
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.classify(docs(ROWS), table, quality.held_out("doc_id", 3, 1)).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {score}
    assert quality.classify(docs([]), table, quality.held_out("doc_id", 3, 1)).count() == 0
    assert rows[0].predicted == (score >= 0.5)
    kept = quality.keep_good(docs(ROWS), table, quality.held_out("doc_id", 3, 1))
    assert kept.columns == docs(ROWS).columns and kept.count() == (0 if score < 0.5 else len(ROWS))


def test_toxicity_without_both_classes(spark, docs):
    for labels in ([], [(9, 0)], [(7, 1), (9, None)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        rows = toxicity.classify(docs(ROWS), table, quality.held_out("doc_id", 4, 2)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.classify(docs([]), table, quality.held_out("doc_id", 4, 2)).count() == 0


def test_grammar():
    g = toxicity.Grammar([("idiot", True, 4.0), ("achlich", False, 3.0)])
    score = lambda t: sum(g.clauses(t))
    assert score("the idiot came") == 4.0 and score("idiotic words") == 0 and score("an oxidiot") == 0
    assert score("achlichie wort") == 3.0 and score("achlich") == 0
    assert score("you are an idiot") > score("the idiot came") > score("not an idiot") > 0
    assert score("the idiot came") > score("he said idiot came. ok") / toxicity.AIMED
    assert score("kill the process") == 0 < score("i will kill you")
    assert len(g.clauses("idiot. idiot! fine; idiot")) == 3


def test_lexicon_ignores_copies(spark, docs):
    """Words of a copied text are no insults, words in many contexts are."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    vocabulary = [word() for _ in range(300)]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, labels = [], []
    for k in range(400):
        words = sentence(30)
        if k % 8 == 0:
            words[rng.randrange(30)] = "grobian"
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 8 == 0)))
    copied = "zwetschge " + " ".join(sentence(40))
    for k in range(400, 460):
        rows.append((k, f"{copied} {word()}"))
        labels.append((k, 1))
    rows += [(1000, "here is a grobian of note"), (1001, "a zwetschge of note")]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in toxicity.classify(docs(rows), table, quality.held_out("doc_id", 4, 2)).collect()}
    assert found[1000] == 1 and found[1001] == 0


def test_lexicon_keeps_repeated_insults(spark):
    """One long repetitive text, a usual preceding word and copies do not remove an insult."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    vocabulary = [word() for _ in range(300)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(words(30), 0) for _ in range(300)]
    rows += [(f"{words(12)} {rng.choice(vocabulary)} grobian {words(12)} you flegel {words(6)}", 1) for _ in range(40)]
    rows += [("grobian " * 3000, 1)] + [(f"that stupid idiot came along {k}{word()}", 1) for k in range(30)]
    train = spark.createDataFrame(rows, "text string, y int")
    found = {u for u, whole, _ in toxicity.learn_lexicons(train.withColumn("fold", F.lit(0)))[-1] if whole}
    assert {"grobian", "flegel", "idiot"} <= found and "along" not in found


def test_composed_transducers():
    """The product gives what the five do one after another, on all short clauses."""
    import itertools

    parts = (toxicity.INSULT, toxicity.THREAT, toxicity.NEGATION, toxicity.REPORTING, toxicity.TARGET)
    table, final, start = toxicity.compose(parts)
    for clause in itertools.product("IHTNRO", repeat=4):
        state, tapes = start, [0.0, 0.0]
        for c in clause:
            state, a, b = table[state, c]
            tapes = [tapes[0] + a, tapes[1] + b]
        got = tapes[0] * final[state][0] + tapes[1] * final[state][1]
        want = 0.0
        for at, c in enumerate(clause):
            if c in "IH":
                negated = any(x == "N" for x in clause[max(0, at - toxicity.REACH) : at])
                weight = (toxicity.NEGATED if negated else 1) * (toxicity.REPORTED if "R" in clause[:at] else 1)
                want += weight * (toxicity.AIMED if "T" in clause else c == "I")
        assert abs(got - want) < 1e-12, clause


def test_clauses_of_long_texts_take_time_in_proportion():
    import time

    g, took = toxicity.Grammar([("idiot", True, 4.0)]), []
    for n in (40_000, 160_000):
        start = time.perf_counter()
        assert len(g.clauses("an idiot came by; " * n)) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 1


def test_fit_like_direct_solve(spark):
    """Normal equations summed by partitions against one solve over all rows, with random features and without."""
    rng = np.random.default_rng(2)
    dims = len(quality.STATISTICS)
    stats = rng.normal(0, 1, (600, 2))[:, np.arange(dims) % 2] + rng.normal(0, 0.01, (600, dims))
    y = ((stats[:, 0] ** 2 + stats[:, 1] ** 2) > 2).astype(int)  # no plane parts these
    u = rng.random(600)
    table = spark.createDataFrame([(stats[k].tolist(), int(y[k]), float(u[k])) for k in range(600)], "stats array<double>, y int, u double").repartition(5)
    model = quality.fit(table)
    train = u >= quality.CALIBRATION
    x = model.features(stats[train])
    ridge = np.eye(x.shape[1]) * quality.RIDGE * train.sum()
    ridge[-1, -1] = 1e-9
    want = np.linalg.solve(x.T @ x + ridge, x.T @ y[train])
    assert np.abs(model.raw(stats) - model.features(stats) @ want).max() < 1e-6
    rest = ~train
    plain = x[:, quality.FEATURES :]
    flat = np.linalg.lstsq(plain, y[train], rcond=None)[0]
    error = lambda raw: np.mean((raw > 0.5) != y[rest])
    assert error(model.raw(stats[rest])) < error(model.features(stats[rest])[:, quality.FEATURES :] @ flat) - 0.05


def test_isotonic_like_plain_version():
    """Pooled steps against the best rising sequence by the min-max formula."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        m = int(rng.integers(1, 25))
        n = rng.integers(1, 9, m).astype(float)
        hits = np.array([float(rng.integers(0, k + 1)) for k in n])
        best = [max(min(hits[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, m)) for a in range(i + 1)) for i in range(m)]
        x, y = quality.isotonic(np.arange(float(m)), hits, n)
        assert len(x) == len(np.unique(np.round(best, 12)))
        assert all(a <= b for a, b in zip(y, y[1:]))
