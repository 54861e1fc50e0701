"""State with an end, in batch form: a cache with age and size limits, jobs that time out, calls that are tried again."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.operators.keyed_time import micros, ordered_fold

SHARE = 4  # of a full cache, the oldest one in so many entries goes


@dataclass
class Cache:
    """Entries by name: when they were stored, and in which order. Times are whole numbers of one unit."""

    ttl: int
    capacity: int
    entries: dict[str, tuple[int, int]] = field(default_factory=dict)
    place: int = 0

    def ask(self, name: str, now: int) -> tuple[bool, int]:
        """(whether the name is held and not too old, entries that had to go). What is missing is stored."""
        stored = self.entries.get(name)
        if stored and now - stored[0] <= self.ttl:
            return True, 0
        self.entries.pop(name, None)  # too old
        oldest = sorted(self.entries, key=self.entries.__getitem__)[: -(-self.capacity // SHARE)] if len(self.entries) >= self.capacity else []
        for gone in oldest:
            del self.entries[gone]
        self.entries[name] = now, self.place
        self.place += 1
        return False, len(oldest)


def cache_lookups(requests: DataFrame, shard: str, ts: str, tie: str, name: str, ttl: int = 3600, capacity: int = 50) -> DataFrame:
    """shard, tie, hit, evicted, held: each shard is a cache of so many entries that live for ttl seconds; a miss stores the name.

    A full cache drops its oldest quarter before it stores. Entries that are too old count until they are asked for or dropped.
    """

    def step(cache: Cache | None, at: int, name: str) -> tuple[Cache, tuple]:
        cache = cache or Cache(ttl * 1_000_000, capacity)
        hit, evicted = cache.ask(name, at)
        return cache, (hit, evicted, len(cache.entries))

    return ordered_fold(requests, shard, ts, tie, None, step, "hit boolean, evicted int, held int", name).withColumnsRenamed({shard: "shard", tie: "tie"})


def job_ends(events: DataFrame, job: str, ts: str, tie: str, state: str, now: Column, timeout: int = 3600) -> DataFrame:
    """job, state, why, at: the first report that comes within timeout seconds of a job's first event, else FAILED at that time, if now is past it."""
    at = micros(ts)
    report = F.when(F.col(state).isin("COMPLETE", "FAILED"), F.struct(at.alias("at"), F.col(tie).alias("tie"), F.col(state).alias("state")))
    jobs = events.groupBy(F.col(job).cast("string").alias("job")).agg(F.min(at).alias("started"), F.min(report).alias("first"))
    end, first = F.col("started") + timeout * 1_000_000, F.col("first")
    told = first.isNotNull() & (first["at"] <= end)
    rows = jobs.select("job", F.when(told, first["state"]).otherwise("FAILED").alias("state"), F.when(told, "reported").otherwise("timed out").alias("why"), F.when(told, first["at"]).otherwise(end).alias("at"))
    return rows.where((F.col("why") == "reported") | (F.col("at") < F.unix_micros(now.cast("timestamp")))).withColumn("at", F.timestamp_micros("at"))


def backoff(attempt: int, first: int, most: int) -> int:
    """Milliseconds until the next attempt: twice as long each time, up to most."""
    return min(first << attempt, most)


def outcome(attempt: int, failures: int, fatal: bool, retries: int) -> str:
    """Of a call that fails so many times: done, again, or given up, at once where the failure is fatal."""
    return "done" if attempt >= failures else "given up" if fatal or attempt >= retries else "again"


def attempts(calls: DataFrame, call: str, ts: str, failures: str, fatal: str, retries: int = 3, first: int = 1000, most: int = 10_000) -> DataFrame:
    """call, attempt (from 0), at, outcome of every attempt of each call."""
    last = F.when(F.col(fatal), F.lit(0)).otherwise(F.least(F.col(failures), F.lit(retries)))
    waits = [backoff(n, first, most) for n in range(retries)]
    since = F.get(F.array(*[F.lit(sum(waits[:n])).cast("long") for n in range(retries + 1)]), F.col("attempt"))
    rows = calls.select(F.col(call).cast("long").alias("call"), F.unix_millis(F.col(ts).cast("timestamp")).alias("begun"), F.col(failures).alias("failures"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("attempt"), F.col(fatal).alias("fatal"))
    how = F.when(F.col("attempt") >= F.col("failures"), "done").when(F.col("fatal") | (F.col("attempt") >= retries), "given up").otherwise("again")
    return rows.select("call", "attempt", F.timestamp_millis(F.col("begun") + since).alias("at"), how.alias("outcome"))
