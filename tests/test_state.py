"""Streams with state, the partitioned log and published snapshots."""

import datetime
import random
import re

import numpy as np
import pandas as pd
import pytest

from corpusmith.operators import service, tables
from corpusmith.plans import catalog
from corpusmith.sources import sinks
from corpusmith.streaming import state

T0 = datetime.datetime(2024, 3, 1, 22)


def plain_quota(rows, limit):
    """{event_id: (used, admitted)} of rows (tenant, event_id, ts, tokens), one by one."""
    used, out = {}, {}
    for tenant, i, ts, tokens in sorted(rows, key=lambda r: (r[2], r[1])):
        key = (tenant, ts.date())
        fits = limit <= 0 or used.get(key, 0) + tokens <= limit
        used[key] = used.get(key, 0) + max(tokens, 0) * fits
        out[i] = (used[key], fits)
    return out


def events(n, seed=0):
    rng = random.Random(seed)
    return [(rng.randrange(4), i, T0 + datetime.timedelta(minutes=rng.randrange(600)), rng.choice([0, 1, 5, 20, 90, -3])) for i in range(n)]


@pytest.mark.parametrize("limit", [0, 1, 40, 300])
def test_admitted_like_one_by_one(limit):
    rng = np.random.default_rng(limit)
    for n in (0, 1, 7, 200):
        tokens, used = rng.integers(-5, 40, n), int(rng.integers(0, 60))
        want, now = [], used
        for t in tokens:
            fits = limit <= 0 or now + t <= limit
            now += max(int(t), 0) * bool(fits)
            want.append((now, bool(fits)))
        after, fits = tables.admitted(tokens, used, limit)
        assert list(zip(after.tolist(), fits.tolist())) == want


@pytest.mark.parametrize("limit", [0, 1, 40, 300])
def test_many_groups_like_one_by_one(limit):
    rng = np.random.default_rng(limit)
    sizes = [1, 2, 64, 65, 1, 200, 7]
    first, used = np.cumsum([0, *sizes[:-1]]), rng.integers(0, 60, len(sizes))
    tokens = rng.integers(-5, 40, sum(sizes))
    after, fits = tables.admitted_each(tokens, first, used, limit)
    for a, n, u in zip(first, sizes, used):
        want = tables.admitted(tokens[a : a + n], int(u), limit)
        assert after[a : a + n].tolist() == want[0].tolist() and fits[a : a + n].tolist() == want[1].tolist()


class Held:
    """A tenant's state and its timers, with the calls counted."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_windows_of_a_tenant_cost_one_value_and_one_timer():
    budget, held = state.Budget(2, 60, 120), Held()
    budget.init(held)
    minute = 60_000_000
    rows = pd.DataFrame({"window_start": np.repeat(np.arange(500) * minute, 3), "ts": 0, "event_id": range(1500), "tokens": 1})
    out = pd.concat(budget.handleInputRows((7,), iter([rows[:700], rows[700:]]), Clock(0)))
    assert out["admitted"].tolist() == [True, True, False] * 500 and held.calls <= 3
    assert len(held.value[0]) == 500 and held.timers == {180_000}
    # Windows go together once the watermark has passed them, and the timer is that of the first left.
    held.timers.remove(180_000)
    list(budget.handleExpiredTimer((7,), Clock(60_000 * 400), Clock(180_000)))
    assert held.value[0][0] == 398 * minute and held.timers == {60_000 * 401}
    again = pd.concat(budget.handleInputRows((7,), iter([rows[1497:]]), Clock(0)))
    assert not again["admitted"].any() and set(held.value[1]) == {2} and len(held.value[0]) == 102
    held.timers.clear()
    list(budget.handleExpiredTimer((7,), Clock(60_000 * 900), Clock(60_000 * 401)))
    assert held.value is None and not held.timers


def test_tenants_of_a_bucket_cost_one_value():
    budget, held = state.Budget(40, 86_400, 172_800), Held()
    budget.init(held)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "", "none", *map(str, range(300))]), i, T0 + datetime.timedelta(minutes=i % 900), rng.choice([0, 1, 5, 20, 90, -3])) for i in range(4000)]
    frame = pd.DataFrame(rows, columns=["tenant", "event_id", "ts", "tokens"])
    frame["window_start"] = frame["ts"].dt.floor("D").astype("datetime64[us]").astype(np.int64)
    order = frame.sort_values(["ts", "event_id"], kind="stable").index
    parts = [frame.loc[order[:1500]].sample(frac=1, random_state=1), frame.loc[order[1500:]].sample(frac=1, random_state=2)]
    out = []
    for part in parts:
        held.calls = 0
        out += list(budget.handleInputRows((5,), iter([part[:700], part[700:]]), Clock(0)))
        assert held.calls <= 3
    got = pd.concat(out)
    assert {i: (u, a) for i, u, a in zip(got["event_id"], got["used"], got["admitted"])} == plain_quota(rows, 40)
    assert dict(zip(got["event_id"], got["tenant"])) == {r[1]: r[0] for r in rows}


@pytest.mark.parametrize("kind", ["int", "bigint", "string", "date"])
def test_many_tenants_take_few_keys(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(state, "BUCKETS", 3)
    made = {"int": int, "bigint": lambda t: (1 << 60) + t, "string": lambda t: f"t{t}", "date": lambda t: datetime.date(2024, 1, 1) + datetime.timedelta(days=t)}[kind]
    rng = random.Random(8)
    rows = [(None if (t := rng.randrange(9)) == 8 else made(t), *r[1:]) for r in sorted(events(150), key=lambda r: (r[2], r[1]))]
    got = fed(spark, tmp_path, [rows[:70], rows[70:]], f"tenant {kind}, event_id int, ts timestamp_ntz, tokens long", lambda s: state.admissions(s, 60))
    assert {r.event_id: (r.used, r.admitted) for r in got} == plain_quota(rows, 60)
    assert {r.event_id: r.tenant for r in got} == {r[1]: r[0] for r in rows}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_quota_days_are_in_utc(spark, zone):
    rows = events(300)
    frame = spark.createDataFrame([(t, i, ts.replace(tzinfo=datetime.timezone.utc), k) for t, i, ts, k in rows], "tenant int, event_id int, ts timestamp, tokens long")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {r.event_id: (r.used, r.admitted) for r in tables.quota(frame, 100).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == plain_quota(rows, 100)


def fed(spark, folder, rows, schema, make):
    """What a stream has written after each of the given batches of rows."""
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        state.run_once(make(spark.readStream.schema(schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").collect()


def test_admissions_over_several_batches(spark, tmp_path):
    rows = sorted(events(120), key=lambda r: (r[2], r[1]))
    schema = "tenant int, event_id int, ts timestamp_ntz, tokens long"
    # The second batch repeats the first one, the last one comes far too late.
    late = (0, 1000, T0 - datetime.timedelta(days=5), 1)
    got = fed(spark, tmp_path, [rows[:50], rows[:50], rows[50:], [late, (1, 1001, None, 1)]], schema, lambda s: state.admissions(s, 100))
    assert len(got) == 120 and {r.event_id: (r.used, r.admitted) for r in got} == plain_quota(rows, 100)


def test_transitions_over_several_batches(spark, tmp_path):
    rng = random.Random(5)
    log = [(rng.randrange(9), i, T0 + datetime.timedelta(seconds=i // 2), rng.choice(["queue", "dequeue", "complete", "fail", "odd"]), f"e{i}") for i in range(80)]
    schema = "job int, id int, at timestamp_ntz, action string, error string"
    got = fed(spark, tmp_path, [log[:30], log[20:60], log[60:]], schema, state.transitions)
    assert len(got) == 80
    status, error, moved = {}, {}, {}
    for job, i, _, action, text in log:
        now = status.get(job)
        goes = {"queue": now is None, "dequeue": now == "queued", "complete": now is not None, "fail": now is not None}.get(action, False)
        moved[i] = goes
        if goes:
            status[job] = {"queue": "queued", "dequeue": "processing", "complete": "complete", "fail": "failed"}[action]
            error[job] = text if action == "fail" else None
    assert {r.id: r.moved for r in got} == moved
    assert {r.job: (r.status, r.error) for r in service.queue_outcomes(spark.createDataFrame(log, schema)).collect()} == {j: (s, error[j]) for j, s in status.items()}


@pytest.mark.parametrize("batch, stream", [("quota_daily", "quota_stream"), ("queue_outcomes", "queue_stream")])
def test_streams_equal_their_batches(spark, sf_dir, batch, stream):
    one, two = (catalog.queries()[n](spark, sf_dir) for n in (batch, stream))
    assert sorted(map(tuple, one.select(*sorted(one.columns)).collect()), key=repr) == sorted(map(tuple, two.select(*sorted(two.columns)).collect()), key=repr)


def test_rate_stream(spark, sf_dir):
    rows, n = spark.read.parquet(f"{sf_dir}/events.parquet").collect(), {}
    for r in rows:
        key = (r.user_id, r.ts.replace(second=0, microsecond=0))
        n[key] = n.get(key, 0) + 1
    want = {}
    for (user, _), count in n.items():
        want[user] = (want.get(user, (0, 0))[0] + max(0, count - 2), want.get(user, (0, 0))[1] + count)
    assert {r.user_id: (r.n_limited, r.n) for r in catalog.queries()["rate_stream"](spark, sf_dir).collect()} == want


def test_log_by_month(spark, tmp_path, capsys):
    days = [datetime.datetime(2024, 1, 31, 23, 59), datetime.datetime(2024, 2, 1), datetime.datetime(2024, 2, 29), datetime.datetime(2024, 3, 1), datetime.datetime(2019, 1, 1), None]
    rows = spark.createDataFrame(list(enumerate(days)), "id int, at timestamp_ntz")
    path = str(tmp_path / "log")
    sinks.write_log(rows, path, "at", ["2024_01", "2024_02"])
    assert {r.id: r.month for r in spark.read.parquet(path).collect()} == {0: "2024_01", 1: "2024_02", 2: "2024_02", 3: "default", 4: "default", 5: "default"}
    span = sinks.read_log(spark, path, "at", datetime.date(2024, 2, 1), datetime.date(2024, 3, 2))
    assert sorted(r.id for r in span.collect()) == [1, 2, 3]
    span.explain("formatted")
    assert re.search(r"PartitionFilters: \[month#\d+ IN \(2024_02,2024_03,default\)\]", capsys.readouterr().out)
    # Writing a month again replaces it and leaves the others.
    sinks.write_log(rows.where("id = 1"), path, "at", ["2024_01", "2024_02"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 3, 4, 5]


def test_log_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").collect()
    first = min(r.ts for r in rows)
    span = [(first.year * 12 + first.month - 1 + k) for k in (0, 1)]
    want = {}
    for r in rows:
        at = r.ts.year * 12 + r.ts.month - 1
        if at in span:
            key = (f"{r.ts:%Y_%m}" if at == span[0] else "default", r.event_type)
            want[key] = (want.get(key, (0, 0))[0] + 1, want.get(key, (0, 0))[1] + r.event_id)
    assert {(r.month, r.event_type): (r.n, r.ids) for r in catalog.queries()["log_partitions"](spark, sf_dir).collect()} == want


def test_a_failed_publish_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "release")
    assert sinks.versions(spark, root) == []
    with pytest.raises(FileNotFoundError):
        sinks.snapshot(spark, root)
    assert sinks.publish(spark.range(5), root) == 1
    broken = spark.range(9).selectExpr("if(id = 7, raise_error('broken'), id) AS id")
    with pytest.raises(Exception, match="broken"):
        sinks.publish(broken, root)
    assert sinks.versions(spark, root) == [1] and [p.name for p in (tmp_path / "release").iterdir()] == ["v1"]
    assert sinks.publish(spark.range(7), root) == 2
    assert sinks.snapshot(spark, root).count() == 7 and sinks.snapshot(spark, root, 1).count() == 5


def test_snapshot_query(spark, sf_dir):
    got = {r.lang: (r.n, r.n_texts) for r in catalog.queries()["published_snapshot"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == {g: (len(x), len({r.text for r in x} - {None})) for g in {r.lang for r in rows} for x in [[r for r in rows if r.lang == g]]}
