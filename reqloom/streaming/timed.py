"""Keyed state with an end: a cache with age and size limits, jobs that time out, calls that are tried again.

Each is a stateful processor over event time, so results depend on the events' own times, not on when they are read, and
state goes when its time is over. The batch forms in operators/expiring.py give the same rows for the same events. Events of
a key come in order of time from batch to batch, as far as the watermark allows; within a batch they are sorted here.

Jobs and calls are many and short, and each key of a processor costs some milliseconds a batch. So they share BUCKETS keys by
hash: a bucket's state is a list of what is open in it, read and written in one go, and its timer is the earliest one due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from reqloom.operators.expiring import Cache, backoff, outcome

BUCKETS = 512  # part of the state: another number needs a new checkpoint
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> None:
    """Stateful processors need the state store that keeps state on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by))


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


class _CacheProcessor(StatefulProcessor):
    """MapState: name to (time stored, place in order of storing). A batch reads a shard's entries once and writes back what changed."""

    def __init__(self, ttl: int, capacity: int):
        self.ttl, self.capacity = ttl, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "name string", "stored long, place long")
        self.clock = handle.getValueState("clock", "place long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: (v[0], v[1]) for k, v in self.entries.iterator()}
        cache = Cache(self.ttl, self.capacity, dict(before), self.clock.get()[0] if self.clock.exists() else 0)
        out = []
        frame = _sorted(rows, "at", "tie")
        for at, tie, name in zip(frame["at"].tolist(), frame["tie"].tolist(), frame["name"].tolist(), strict=True):
            hit, evicted = cache.ask(name, at)
            out.append((key[0], tie, hit, evicted, len(cache.entries)))
        for name in before.keys() - cache.entries.keys():
            self.entries.removeKey((name,))
        for name, value in cache.entries.items():
            if before.get(name) != value:
                self.entries.updateValue((name,), value)
        self.clock.update((cache.place,))
        yield pd.DataFrame(out, columns=["shard", "tie", "hit", "evicted", "held"])

    def close(self) -> None:
        pass


def cache_lookups(requests: DataFrame, shard: str, ts: str, tie: str, name: str, ttl: int = 3600, capacity: int = 50, late: str = "0 seconds") -> DataFrame:
    """shard, tie, hit, evicted, held of each request, as expiring.cache_lookups has them."""
    given = requests.withWatermark(ts, late).select(F.col(shard).cast("long").alias("shard"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(name).cast("string").alias("name"))
    return given.groupBy("shard").transformWithStateInPandas(_CacheProcessor(ttl * 1_000_000, capacity), "shard long, tie long, hit boolean, evicted int, held int", "Append", "None")


class _JobProcessor(StatefulProcessor):
    """ListState: (job, started, ended); the last entry of a job counts. A timer at the end of the first job's time; after a job's end the list forgets it."""

    def __init__(self, timeout: int, keep: int):
        self.timeout, self.keep = timeout, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", "job string, started long, ended boolean")

    def _held(self) -> dict[str, tuple[int, bool]]:
        return {job: (started, ended) for job, started, ended in self.jobs.get()} if self.jobs.exists() else {}

    def _due(self, started: int, ended: bool) -> int:
        return (started + self.timeout + self.keep) // 1000 + 2 if ended else (started + self.timeout) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, changed, out, due, frame = self._held(), {}, [], [], _sorted(rows, "at", "tie")
        for job, at, state in zip(frame["job"].tolist(), frame["at"].tolist(), frame["state"].tolist(), strict=True):
            started, ended = held.get(job, (None, False))
            if started is None:
                started = at
                due.append(self._due(started, False))
            elif ended:
                continue
            if at > started + self.timeout:
                ended = True
                out.append((job, "FAILED", "timed out", started + self.timeout))
            elif state in ("COMPLETE", "FAILED"):
                ended = True
                out.append((job, state, "reported", at))
            held[job] = changed[job] = started, ended
        if changed:
            self.jobs.appendList([(job, *x) for job, x in changed.items()])
        if due:
            self.handle.registerTimer(min(due))
        yield pd.DataFrame(out, columns=["job", "state", "why", "at"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        left, out = {}, []
        for job, (started, ended) in self._held().items():
            if not ended and self._due(started, False) <= now:
                ended = True
                out.append((job, "FAILED", "timed out", started + self.timeout))
            if not ended or self._due(started, True) > now:  # long over: a repeated report would be a new job
                left[job] = started, ended
        if left:
            self.jobs.put([(job, *x) for job, x in left.items()])
            self.handle.registerTimer(min(self._due(*x) for x in left.values()))
        else:
            self.jobs.clear()
        yield pd.DataFrame(out, columns=["job", "state", "why", "at"])

    def close(self) -> None:
        pass


def job_ends(events: DataFrame, job: str, ts: str, tie: str, state: str, timeout: int = 3600, keep: int = 604_800, late: str = "0 seconds") -> DataFrame:
    """job, state, why, at: how each job ends, once; FAILED when its time is over, as expiring.job_ends has it. Ended jobs are remembered for keep seconds."""
    given = events.withWatermark(ts, late).select(_bucket(job), F.col(job).cast("string").alias("job"), ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(state).alias("state"))
    out = given.groupBy("bucket").transformWithStateInPandas(_JobProcessor(timeout * 1_000_000, keep * 1_000_000), "job string, state string, why string, at long", "Append", "EventTime")
    return out.select("job", "state", "why", F.timestamp_micros("at").alias("at"))


class _RetryProcessor(StatefulProcessor):
    """ListState: the next attempt of each open call, and how the call will go. A timer at the first attempt due."""

    def __init__(self, retries: int, first: int, most: int):
        self.retries, self.first, self.most = retries, first, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", "call string, attempt int, at long, failures int, fatal boolean")

    def _tried(self, calls: list[tuple], now: int) -> tuple[list[tuple], list[tuple]]:
        """(call, attempt, at, outcome) of this attempt of each call and those after it that are due by now; the calls that stay open."""
        out, left = [], []
        for call, attempt, at, failures, fatal in calls:
            how, tried = "again", False
            while how == "again" and (not tried or at <= now):
                how, tried = outcome(attempt, failures, fatal, self.retries), True
                out.append((call, attempt, at, how))
                attempt, at = attempt + 1, at + backoff(attempt, self.first, self.most)
            if how == "again":
                left.append((call, attempt, at, failures, fatal))
        return out, left

    def _open(self) -> list[tuple]:
        return [tuple(x) for x in self.calls.get()] if self.calls.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, new = {x[0] for x in self._open()}, []
        frame = _sorted(rows, "at")
        for call, at, failures, fatal in zip(*(frame[c].tolist() for c in ("call", "at", "failures", "fatal")), strict=True):
            if call not in held:
                held.add(call)
                new.append((call, 0, int(at), int(failures), bool(fatal)))
        out, left = self._tried(new, timerValues.getCurrentWatermarkInMs())
        if left:
            self.calls.appendList(left)
            self.handle.registerTimer(min(x[2] for x in left))
        yield pd.DataFrame(out, columns=["call", "attempt", "at", "outcome"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), self._open()
        out, left = self._tried([x for x in held if x[2] <= now], now)
        left += [x for x in held if x[2] > now]
        if left:
            self.calls.put(left)
            self.handle.registerTimer(min(x[2] for x in left))
        else:
            self.calls.clear()
        yield pd.DataFrame(out, columns=["call", "attempt", "at", "outcome"])

    def close(self) -> None:
        pass


def attempts(calls: DataFrame, call: str, ts: str, failures: str, fatal: str, retries: int = 3, first: int = 1000, most: int = 10_000, late: str = "0 seconds") -> DataFrame:
    """call, attempt, at, outcome of every attempt, as expiring.attempts has them. Each call comes once."""
    given = calls.withWatermark(ts, late).select(_bucket(call), F.col(call).cast("long").cast("string").alias("call"), ts, F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.col(failures).cast("int").alias("failures"), F.col(fatal).alias("fatal"))
    out = given.groupBy("bucket").transformWithStateInPandas(_RetryProcessor(retries, first, most), "call string, attempt int, at long, outcome string", "Append", "EventTime")
    return out.select(F.col("call").cast("long").alias("call"), "attempt", F.timestamp_millis("at").alias("at"), "outcome")
