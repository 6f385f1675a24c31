"""Decontamination against a brute-force version and literal cases."""

import random
import re

import pytest

from corpusmith.llm import decontam, queries

ITEM = "If a train travels 120 km in 3 hours and stops in Berlin for 15 minutes, how far does it travel before reaching Berlin at noon on that day"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long, id int")


def found(docs_df, items_df):
    return sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(docs_df, items_df).collect()), key=repr)


def hits(spark, docs, texts, *asked):
    """Which of the texts (numbered from 0) hold which items (from 0)."""
    return found(docs(list(enumerate(texts))), items(spark, [(k, t, 1, 1) for k, t in enumerate(asked)]))


def test_literal_cases(spark, docs):
    other = ITEM.replace("120", "480").replace("Berlin", "Lisbon").replace(" 3 ", " 6 ")
    mixed = ITEM.replace("in Berlin", "in Lisbon").replace("120", "77")  # one name answered by two
    rows = [(1, f"Intro text here. {ITEM} and more follows"), (2, f"some lead, {other}."), (3, mixed), (4, "nothing alike in this text at all, only words"), (5, None), (6, ""), (7, ITEM[: len(ITEM) // 2]), (8, ITEM.upper())]
    got = found(docs(rows), items(spark, [(10, ITEM, 1, 1), (11, None, 1, 1), (12, "", 1, 1), (13, "short one", 1, 1)]))
    assert got == [(1, 10), (2, 10), (8, 10)]


def test_short_items_inside_longer_texts(spark, docs):
    texts = ["We ask: who wrote Hamlet? Nobody knows it here.", "who wrote hamlet", "Who wrote\nMacbeth, one may ask", "a short one here", "one short", "It costs 5 euros", "It costs 6 euros", "hamlet who wrote"]
    assert hits(spark, docs, texts, "Who wrote Hamlet", "short one", "costs 5 euros", "Hamlet!") == [(0, 0), (0, 3), (1, 0), (1, 3), (3, 1), (5, 2), (7, 3)]


def test_names_at_the_start_and_one_way_slots(spark, docs):
    asked = ["Alice has 5 red apples to sell today", "5 apples and 7 pears", "What is the capital of France", "3 cats and 3 dogs"]
    texts = ["So: Bob has 7 red apples to sell today, they say.", "6 apples and 6 pears", "What is the capital of Spain?", "what is the capital of spain?", "2 cats and 9 dogs", "4 cats and 4 dogs", "bob has 7 red apples to sell today", "Carol has many red apples to sell today"]
    assert hits(spark, docs, texts, *asked) == [(0, 0), (1, 1), (2, 2), (5, 3)]


def test_capitals_at_a_sentence_start_and_spelled_numbers(spark, docs):
    asked = ["What is 12 plus 30", "what is 12 plus 30", "12 km 3 hours 40 km 8 minutes", "Tom has three red apples and two green pears to sell", "It takes twenty-five days to get there by ship", "7 8 9 10 11 12", "There are two hundred and six bones in us"]
    texts = [
        "What is 77 plus 41", "So what is 5 plus 6, one asks", "5 km 9 hours 61 km 2 minutes", "5 kg 9 hours 61 kg 2 minutes", "Tom has 3 red apples and 2 green pears to sell",
        "Well. Ann has five red apples and 7 green pears to sell", "it takes 40 days to get there by ship", "It takes three hundred days to get there by ship", "1 2 3 4 5 6", "7 8 9 ten eleven 12", "There are 200 and 6 bones in us",
    ]
    assert hits(spark, docs, texts, *asked) == [(0, 0), (0, 1), (1, 0), (1, 1), (10, 6), (2, 2), (4, 3), (5, 3), (6, 4), (7, 4), (9, 5)]


def test_rows_without_id_and_shared_ids(spark, docs):
    half = len(ITEM) // 2
    rows = docs([(None, f"lead {ITEM}"), (None, "clean words only stand here in a row"), (4, ITEM[:half]), (4, ITEM[half:]), (5, "clean too, all of this text"), (5, ITEM)])
    bench = items(spark, [(10, ITEM, 1, 1), (None, "quite another benchmark item without any id", 1, 1)])
    assert found(rows, bench) == [(5, 10), (None, 10)]
    kept = decontam.clean(rows, bench)
    assert kept.columns == rows.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, "clean words only stand here in a row"), (4, ITEM[:half]), (4, ITEM[half:]), (5, "clean too, all of this text")], key=repr)
    assert found(docs([(1, "see quite another benchmark item without any id.")]), bench) == [(1, None)]


def test_empty_and_repeated(spark, docs):
    assert found(docs([]), items(spark, [(1, ITEM, 1, 1)])) == []
    assert found(docs([(1, ITEM)]), items(spark, [])) == []
    assert found(docs([(1, ITEM), (1, ITEM), (2, ITEM)]), items(spark, [(1, ITEM, 1, 1), (2, ITEM, 1, 1)])) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    kept = decontam.clean(docs([(1, ITEM), (2, "fine words in here all along"), (3, None)]), items(spark, [(1, ITEM, 1, 1)]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and kept.columns == docs([]).columns
    long = "word " * 30_000 + ITEM + " word" * 30_000
    assert hits(spark, docs, [long, "w " * 50_000], ITEM, "w w w w w w w w") == [(0, 0), (1, 1)]


def test_occurrences_do_not_disturb_each_other(spark, docs):
    """A verbatim copy and variants in one document, equal numbers, one number in two roles."""
    variant = lambda a, b, c, name: ITEM.replace("120", a).replace(" 3 ", f" {b} ").replace(" 15 ", f" {c} ").replace("Berlin", name)
    other, third = variant("480", "6", "25", "Lisbon"), variant("77", "8", "41", "Madrid")
    rows = [(1, f"{ITEM}. Or so: {other}."), (2, f"See, {other}. Then {third}."), (3, variant("9", "9", "9", "Lisbon")), (4, f"Well, {variant('50', '5', '8', 'Lisbon')}.")]
    assert found(docs(rows), items(spark, [(10, ITEM, 1, 1)])) == [(d, 10) for d in (1, 2, 3, 4)]
    wrong = "1 2 3 4 5 6 7 8 9 1 2 3"
    assert found(docs([(1, "4 4 4 9 9 1 1 1 2 7 5 5 0 3 3 3"), (2, f"see {wrong}")]), items(spark, [(10, wrong, 1, 1)])) == [(2, 10)]


def test_case_and_place_of_names(spark, docs):
    rows = [(1, ITEM.lower()), (2, ITEM.upper()), (3, ITEM.replace(" Berlin", "\nBerlin")), (4, ITEM.replace(" Berlin", "  Berlin")), (5, ITEM.replace("Berlin", "BONN"))]
    assert found(docs(rows), items(spark, [(10, ITEM, 1, 1)])) == [(d, 10) for d in (1, 2, 3, 4, 5)]
    sums = "Alice has 3 red apples and buys 5 more at the market. Bob gives her 4 of his own apples. How many apples does she then have in her basket"
    other = sums.replace("Alice", "Carol").replace("Bob", "David").replace("3", "8").replace("4", "six")
    assert found(docs([(1, other), (2, "Nothing of all that. " + other)]), items(spark, [(10, sums, 1, 1)])) == [(1, 10), (2, 10)]


# A plain version: every text beside every item at every shift.


def words(text):
    text = text.replace("\x01", " ").replace("\x02", " ").replace("İ", "I")
    parts = re.split(rf"(?<![^\W_])({'|'.join(sorted(decontam.SPELLED, key=len, reverse=True))})(?![^\W_])", text, flags=re.I)
    values = [decontam.SPELLED[w.lower()] for w in parts[1::2]]
    text = parts[0]
    for k, v in enumerate(values):
        after = parts[2 * k + 2]
        joins = after in (" ", "-") and k + 1 < len(values) and (v >= 20 or values[k + 1] >= 100)
        text += f"{v}{chr(2) if joins else after}"
    text = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "\x02", text)
    out, last = [], 0
    for m in re.finditer(rf"(?<![^\W_])(?<!\x02)([0-9][0-9\x02]*)(?:[ ]?({decontam.UNITS})(?![^\W_]))?|[^\W_]+", text, re.I):
        if m[1]:
            out.append((m[1], "n"))
            out += [(m[2].lower(), "u")] if m[2] else []
        else:
            starts = not out or re.search(r"[.!?\n]", text[last : m.start()])
            out.append((m[0].lower(), ("c" if starts else "p") if m[0][0].isupper() else ""))
        last = m.end()
    return out


def holds(item, text):
    """Whether an item (words) is found in a text (words)."""
    n, width = len(item), min(5, len(item))
    if not n:
        return False
    wordy = 2 * sum(k in ("", "c") for _, k in item) >= n
    free = n >= 5 and 2 * sum(k in ("", "c", "u") for _, k in item) >= n
    plain = [tuple("#" if k in "nu" and k else v for v, k in item[j : j + width]) for j in range(n - width + 1)]
    rep = [plain.index(p) for p in plain]
    item = item if wordy else [(v, "" if k == "u" else k) for v, k in item]

    def fit(t, d):
        return t[0] == d[0] or (free and ({t[1], d[1]} <= {"p", "c"} or (t[1] == d[1] and t[1] in ("n", "u"))))

    shifts = {}
    for s in range(-n, len(text)):
        fits = [0 <= s + i < len(text) and fit(item[i], text[s + i]) for i in range(n)]
        won = [j for j in range(len(plain)) if all(fits[j : j + width])]
        if won:
            under = {i for j in won for i in range(j, j + width) if item[i][1]}
            shifts[s] = ({rep[j] for j in won}, [(item[i][0], text[s + i][0]) for i in under])
    stretches, last = [], None
    slack = max(1, int(len(set(rep)) * (1 - decontam.SHARE)))
    for s in sorted(shifts):
        stretches += [[]] if last is None or s - last > slack else []
        stretches[-1].append(s)
        last = s
    for scope in [[s] for s in shifts] + stretches + [list(shifts)]:
        seen, answers = set(), {}
        for s in scope:
            seen |= shifts[s][0]
            for a, b in shifts[s][1]:
                answers.setdefault(a, []).append(b)
        good, all_ = sum(max(map(x.count, x)) for x in answers.values()), sum(map(len, answers.values()))
        if len(seen) >= decontam.SHARE * len(set(rep)) and good >= decontam.SLOT_SHARE * all_:
            return True
    return False


def test_like_brute_force_with_slots(spark, docs):
    """Items with numbers, units and names; copies that are changed, cut, put in other words or mixed."""
    rng = random.Random(9)
    plain = "the of a train moves from here to there while some old dogs sleep below green trees near our town by night and day".split()
    names, units = "Berlin Lisbon Madrid Oslo Rome Alice Bob Carol".split(), ["km", "hours", "kg", "%", "miles"]

    def sentence(n):
        out = [rng.choice(names) if rng.random() < 0.3 else rng.choice(plain).capitalize()]
        while len(out) < n:
            x = rng.random()
            out += [str(rng.randrange(2, 99)), rng.choice(units)] if x < 0.12 else [rng.choice(names)] if x < 0.25 else ["three"] if x < 0.28 else [str(rng.randrange(2, 9))] if x < 0.35 else [rng.choice(plain)]
        return " ".join(out)

    def changed(text):
        swap = {n: rng.choice(names) for n in names}
        text = " ".join(swap.get(w, w) for w in text.split())
        return re.sub(r"\d+", lambda m: str(rng.randrange(2, 99)) if rng.random() < 0.8 else m[0], text)

    def edited(text):
        parts = text.split()
        at = rng.randrange(len(parts))
        return " ".join(parts[:at] + rng.choice([[], ["indeed"], parts[at : at + 1] * 2]) + parts[at + 1 :])

    asked = [sentence(rng.choice([2, 3, 4, 5, 6, 8, 12, 20, 30])) for _ in range(60)]
    texts = []
    for t in asked:
        for make in (str, str.lower, changed, edited, lambda x: edited(changed(x)), lambda x: x[: len(x) * 2 // 3]):
            texts.append(f"{sentence(rng.randrange(1, 15))}. {make(t)} {sentence(rng.randrange(1, 15))}")
    got = set(hits(spark, docs, texts, *asked))
    want = {(d, i) for d, t in enumerate(texts) for i, a in enumerate(asked) if holds(words(a), words(t))}
    assert not got - want
    assert len(want) > 150 and not want - got, [(asked[i], texts[d]) for d, i in sorted(want - got)]


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_query(spark, sf_dir):
    """The whole tables against the share of each item's plain windows that a text holds anywhere."""
    shingles = lambda t: {tuple(v for v, _ in w[k : k + 5]) for w in [words(t)] for k in range(max(1, len(w) - 4))}
    texts = {r.doc_id: shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    asked = {r.item_id: shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(d, i): len(a & s) for d, s in texts.items() for i, a in asked.items() if len(a & s) >= 0.8 * len(a)}
    got = {(r.doc_id, r.item_id): r.n_found for r in queries.op4_decontamination(spark, sf_dir).collect()}
    assert want and got.keys() == want.keys() and all(got[k] >= n for k, n in want.items())
