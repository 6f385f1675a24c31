"""The late-arrival overwrite against brute force over the same rows, and its files one by one."""

import binascii
import datetime
import hashlib
import math
import os
import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusmith.llm import late, queries

START, CUTOFF = datetime.datetime(1970, 1, 1), queries.LATE_FROM
NAMES = ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"]
SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def micro(t):
    return (t - START) // datetime.timedelta(microseconds=1)


def day(t):
    return -1 if t is None else micro(t) // late.DAY_MICROS


def copied(rows):
    out = list(rows)
    for r in rows:
        h = None if r[0] is None else binascii.crc32(str(r[0]).encode())
        if h is not None and h % 3 == 0 and r[4] is not None and day(r[4]) % 7 == 0:
            shift = lambda t, n: t and t + datetime.timedelta(days=n)
            out.append((*r[:3], None if r[3] is None else r[3] + 1, shift(r[4], h % 2), shift(r[5], 1 + h % 97), r[6]))
    return out


def newest(rows):
    low = lambda x: (x is not None, x)  # noqa: E731  nulls smallest
    best = {}
    for r in rows:
        rank = [low(r[5]), *(low(r[k]) for k in (1, 2, 3, 4, 6))]
        if r[0] not in best or rank > best[r[0]][0]:
            best[r[0]] = (rank, r)
    return {k: r for k, (_, r) in best.items()}


def brute(rows, size):
    """{(day, file_no): (n_rows, cents, rows_crc, ids_sha256, rewritten)}."""
    early = [r for r in rows if r[5] is not None and r[5] < CUTOFF]
    start, final = newest(early), newest(rows)
    kept_late = {k for k, r in final.items() if r[5] is None or r[5] >= CUTOFF}
    touched = {day(final[k][4]) for k in kept_late} | {day(start[k][4]) for k in kept_late if k in start}
    days = defaultdict(list)
    for r in final.values():
        days[day(r[4])].append(r)
    out = {}
    for d, held in days.items():
        held.sort(key=lambda r: ((r[4] is not None, r[4]), (r[0] is not None, r[0])))
        for f in range(math.ceil(len(held) / size)):
            part = held[f * size : (f + 1) * size]
            text = ["" if r[0] is None else str(r[0]) for r in part]
            crc = sum(binascii.crc32(f"{i}:{'' if r[4] is None else micro(r[4])}:{'' if r[5] is None else micro(r[5])}".encode()) for i, r in zip(text, part))
            cents = sum(0 if r[3] is None else math.floor(100 * r[3] + 0.5) for r in part)
            out[d, f] = (len(part), cents, crc, hashlib.sha256(",".join(text).encode()).hexdigest(), d in touched)
    return out


def sales(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        sold = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=int(rng.random() ** 2 * 120), seconds=rng.randrange(86400) if rng.random() < 0.7 else 0, microseconds=rng.choice([0, 0, 1, 999_999]))
        rows.append((k, rng.randrange(9), rng.choice(["done", None]), round(rng.random() * 90, 2) if rng.random() < 0.9 else None, sold if rng.random() < 0.97 else None, sold + datetime.timedelta(seconds=rng.randrange(3_000_000)), k % 5))
    return rows


def given(files):
    return {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in files}


def run(spark, rows, size):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made, days = late.overwrite(late.with_copies(table), CUTOFF, size)
    return made, late.described(made, days).collect()


def data_files(made):
    top = made.path.removeprefix("file:").replace("//", "/")
    return sorted(os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("size", [1, 4])
def test_like_brute_force(spark, size):
    rows = sales(150)
    # Sales that come again late, move to another day, repeat as they are, tie, or have no id or arrival.
    moved = datetime.datetime(2024, 4, 20, 5)
    rows += [(3, 1, "done", 5.0, moved, moved, 1), (4, 1, "done", 5.0, None, moved, 1), (5, None, None, None, moved, None, None)]
    rows += [rows[7], rows[7], (8, 1, "done", 1.0, moved, moved, 1), (8, 1, "done", 2.0, moved, moved, 1)]
    rows += [(None, 1, "done", 1.0, moved, moved, 1), (None, 2, "done", 1.0, datetime.datetime(2024, 2, 1), datetime.datetime(2024, 2, 1), 1), (9_999, 1, "x", 1.0, moved, None, 1), (9_998, 1, "x", float("nan"), datetime.datetime(1969, 12, 20, 3), datetime.datetime(1969, 12, 21), 1)]
    rows = [r for r in rows if not (r[3] is not None and math.isnan(r[3]))] + [(9_997, 1, "x", -1.005, datetime.datetime(1969, 12, 20, 3), datetime.datetime(1969, 12, 21), 1)]
    made, found = run(spark, rows, size)
    assert given(found) == brute(copied(rows), size)
    assert {r.columns for r in found} == {",".join(NAMES)} and len({r.path for r in found}) == len(found) == len(data_files(made))
    for r in found:
        assert pq.read_schema(r.path.removeprefix("file:")).names == NAMES


def test_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/sales.parquet").collect()]
    found = queries.queries()["op11_late_overwrite"](spark, sf_dir).collect()
    assert given(found) == brute(copied(rows), 1 + len(rows) // queries.LATE_FILES)


def test_other_days_stay_untouched(spark):
    rows = sales(60, 2)
    table = spark.createDataFrame(rows, SCHEMA)
    made = late.layout(table, 3)
    made.write(made.latest(table), made.path)
    before = {p: open(p, "rb").read() for p in data_files(made)}
    sold = [r for r in rows if r[4] is not None][5]
    days = late.merge(made, spark.createDataFrame([(*sold[:4], datetime.datetime(2024, 4, 29), datetime.datetime(2025, 1, 1), 0)], SCHEMA))
    assert days == sorted({day(sold[4]), day(datetime.datetime(2024, 4, 29))})
    after = {p: open(p, "rb").read() for p in data_files(made)}
    same = {p for p in before if not any(f"/day={d}/" in p for d in days)}
    assert same and all(after.get(p) == before[p] for p in same)
    assert {p for p in after if p not in same} and not any(p in before for p in after if p not in same)


def test_a_day_that_empties_has_no_files(spark):
    one, two = datetime.datetime(2024, 1, 3), datetime.datetime(2024, 4, 15)
    made, found = run(spark, [(1, 1, "a", 1.0, one, one, 1), (1, 1, "a", 2.0, two, two, 1)], 5)
    assert [(r.day, r.n_rows, r.cents, r.rewritten) for r in found] == [(day(two), 1, 200, True)] and len(data_files(made)) == 1


@pytest.mark.parametrize("when", [[], [datetime.datetime(2024, 1, 3, 4)], [datetime.datetime(2024, 4, 20)]])
def test_empty_sides(spark, when):
    rows = [(k, 1, "a", 1.0, t, t, 1) for k, t in enumerate(when)]
    _, found = run(spark, rows, 2)
    assert given(found) == brute(copied(rows), 2)


def test_clashing_columns_are_kept(spark):
    """Extra columns may have the names that the layout would give its own."""
    rows = spark.createDataFrame([(k, datetime.datetime(2024, 1 + k % 4, 5), datetime.datetime(2024, 1 + k % 4, 25), k, "x", 7, 1) for k in range(12)], "sale_id long, sold_at timestamp, arrived_at timestamp, day int, file_no string, row int, part int")
    made, days = late.overwrite(rows, CUTOFF, 2)
    assert (made.day, made.file) == ("_day", "_file_no") and days == [day(datetime.datetime(2024, 4, 5))]
    assert sorted(tuple(r) for r in made.read().select(*rows.columns).collect()) == sorted(tuple(r) for r in rows.collect())


def test_filter_never_denies_a_key(spark):
    keys = spark.range(0, 30_000, 3).select(F.col("id").alias("k"))
    words = late.bloom(keys, "k").scalar()
    held = spark.range(30_000).where(late.might_hold(words, F.col("id")))
    assert held.where("id % 3 = 0").count() == 10_000 and held.where("id % 3 <> 0").count() < 100


def test_zone_of_the_session_does_not_matter(spark):
    rows = sales(40, 3)
    want = brute(copied(rows), 3)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert given(run(spark, rows, 3)[1]) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
