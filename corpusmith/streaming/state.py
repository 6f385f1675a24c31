"""Streams that keep state: admission under a budget for each tenant and window, and a job queue's transitions.

State lives in the session's RocksDB store, one value for each key: a job, or a bucket of tenants. What a stream is fed
twice changes nothing: ids that were seen within LATE drop out before the state, and a
micro-batch that runs again after a break starts from the state before it. Events more
than LATE behind the latest are dropped. A budget's counter goes `ttl` seconds after its
window's end, by the events' own time. Within a micro-batch events go by time and id, whatever file they came in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmith.operators import tables

#: Fixed value: seconds that a budget's counter outlives its window. How far behind the latest event one may be.
COUNTER_TTL, LATE = 172_800, "2 days"
#: Buckets that tenants are dealt to. With a key for each tenant a micro-batch took 7 to 11 ms of a task for each. A stream's checkpoint holds to their number.
BUCKETS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ADMITTED = "tenant {0}, window_start long, event_id {1}, tokens long, used long, admitted boolean"
MOVED = "job {0}, id {1}, at timestamp, status string, error string, moved boolean"


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Budget(StatefulProcessor):
    """Lets events in while their window's budget lasts. A key is one tenant, or a bucket of them whose rows say which.
    It has one value: its windows' starts, their use and their tenants, by start; and one timer, for the first of them to
    go. So a micro-batch costs a key the same few calls however many windows and tenants its events are in."""

    def __init__(self, limit: int, seconds: int, ttl: int):
        self.limit, self.outlives = limit, (seconds + ttl) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("windows", "starts array<long>, used array<long>, tenants array<string>")

    def _read(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.held.get() or ((), (), ())
        return np.array(found[0], np.int64), np.array(found[1], np.int64), np.array(found[2], object)

    def _write(self, there: bool, timer: list[int], starts: np.ndarray, used: np.ndarray, tenants: np.ndarray, now: int) -> None:
        """Keeps the windows that outlive now, and the timer of the first. there: whether a value is; timer: the start whose timer is set."""
        stays = starts // 1000 + self.outlives > now
        starts, used, tenants = starts[stays], used[stays], tenants[stays]
        if len(starts):
            self.held.update((starts.tolist(), used.tolist(), tenants.tolist()))
        elif there:
            self.held.clear()
        after = starts[:1].tolist()
        if timer != after:
            for start in timer:
                self.handle.deleteTimer(start // 1000 + self.outlives)
            for start in after:
                self.handle.registerTimer(start // 1000 + self.outlives)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        batch = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        if "tenant" not in batch:
            batch = batch.assign(tenant=key[0])
        old, old_used, old_tenants = self._read()
        # Tenants are told apart by their text; nulls have a key to themselves.
        seen, names = pd.factorize(batch["tenant"], use_na_sentinel=False)
        whose, names = pd.factorize(np.append(old_tenants, np.array(list(map(str, names)), object)))
        old_whose, who = whose[: len(old)], whose[len(old) :][seen]
        windows = batch["window_start"].to_numpy(np.int64)
        order = np.lexsort((batch["event_id"].to_numpy(), batch["ts"].to_numpy(), windows, who))
        batch, windows, who = batch.take(order), windows[order], who[order]
        tokens = batch["tokens"].to_numpy(np.int64)
        first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (windows[1:] != windows[:-1])))
        # What each window used before: its place among those held, -1 for a new one.
        place = pd.MultiIndex.from_arrays([old_whose, old]).get_indexer(pd.MultiIndex.from_arrays([who[first], windows[first]]))
        known = place >= 0
        before = np.zeros(len(first), np.int64)
        before[known] = old_used[place[known]]
        used, admitted = tables.admitted_each(tokens, first, before, self.limit)
        last = used[np.append(first[1:], len(tokens)) - 1]
        changed = known | (last != before)
        rest = np.ones(len(old), bool)
        rest[place[known]] = False
        starts, uses, whose = (np.append(a[rest], b[changed]) for a, b in ((old, windows[first]), (old_used, last), (old_whose, who[first])))
        by_start = np.lexsort((whose, starts))
        self._write(len(old) > 0, old[:1].tolist(), starts[by_start], uses[by_start], names[whose[by_start]], timerValues.getCurrentWatermarkInMs())
        yield batch[["tenant", "window_start", "event_id", "tokens"]].assign(used=used, admitted=admitted)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        # The timer that fired is gone by itself.
        self._write(True, [], *self._read(), max(fired, timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def close(self) -> None:
        pass


def admissions(events: DataFrame, limit: int, seconds: int = 86_400, ttl: int = COUNTER_TTL) -> DataFrame:
    """A stream of events (tenant, event_id, ts, tokens) with the use of their window (of so many seconds, UTC) after each,
    and whether it was let in. What was turned away uses nothing; a limit of 0 or less lets all in. Events without a time
    or tokens are not events."""
    _ready(events.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where("ts is not null and tokens is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])
    width = seconds * 1_000_000
    bucket = F.when(F.col("tenant").isNull(), -1).otherwise(F.pmod(F.xxhash64("tenant"), F.lit(BUCKETS)).cast("int"))
    rows = rows.select(bucket.alias("bucket"), "tenant", "event_id", "ts", F.col("tokens").cast("long").alias("tokens"), (at - F.pmod(at, F.lit(width))).alias("window_start"))
    out = ADMITTED.format(kinds["tenant"], kinds["event_id"])
    return rows.groupBy("bucket").transformWithStateInPandas(Budget(limit, seconds, ttl), out, "Append", "EventTime")


class Jobs(StatefulProcessor):
    """queue makes a job, once; dequeue takes a queued one; complete and fail end any that is there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at", "id"], kind="stable")
        status = self.state.get()[0] if self.state.exists() else None
        before, made, moved = status, [], []
        for action in batch["action"]:
            goes = {"queue": status is None, "dequeue": status == "queued", "complete": status is not None, "fail": status is not None}.get(action, False)
            status = {"queue": "queued", "dequeue": "processing", "complete": "complete", "fail": "failed"}[action] if goes else status
            made.append(status)
            moved.append(goes)
        if status != before:
            self.state.update((status,))
        error = batch["error"].where((batch["action"] == "fail") & pd.Series(moved, batch.index), None)
        yield pd.DataFrame({"job": key[0], "id": batch["id"].to_numpy(), "at": batch["at"].to_numpy(), "status": made, "error": error.to_numpy(), "moved": moved})

    def close(self) -> None:
        pass


def transitions(log: DataFrame) -> DataFrame:
    """A stream of actions (job, id, at, action, error) with the job's status after each, and whether the action was let through."""
    _ready(log.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    rows = log.where("at is not null").withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", LATE).dropDuplicatesWithinWatermark(["id"])
    return rows.groupBy("job").transformWithStateInPandas(Jobs(), MOVED.format(kinds["job"], kinds["id"]), "Append", "None")


def run_once(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Take in all that has come so far, append the results to target, and stop."""
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
