"""Keyed operators over time, in batch form: one window per key, no driver state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sliding_limit(events: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Adds in_window (events of the key in the window that ends here, this one included) and allowed."""
    w = Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("in_window") <= most)


def ordered_fold(events: DataFrame, key: str, ts: str, tie: str, begin, step: Callable[..., tuple], schema: str, *more: str) -> DataFrame:
    """key, tie and what step gives for each event of a key in order of time; step(state, microseconds, values of more) gives the next state and the values.

    Events are dealt by key and sorted there, and batches stream through: a task holds one batch and one key's state, however
    many events the key has. The events of one key are in one task, as each depends on all before it.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, begin
        for batch in batches:
            rows = []
            for k, *given in zip(*(batch.column(c).to_pylist() for c in ("k", "at", *more)), strict=True):
                state = begin if k != last else state
                last = k
                state, values = step(state, *given)
                rows.append(values)
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("tie"), *made], names=["k", "tie", *names])

    kinds = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]
    given = events.where(F.col(ts).isNotNull()).select(F.col(key).cast("long").alias("k"), micros(ts).alias("at"), F.col(tie).cast("long").alias("tie"), *more)
    out = given.repartition("k").sortWithinPartitions("k", "at", "tie").mapInArrow(run, f"k long, tie long, {schema}")
    return out.withColumnsRenamed({"k": key, "tie": tie})


def fixed_limit(events: DataFrame, key: str, ts: str, tie: str, seconds: int, most: int) -> DataFrame:
    """Windows open with the first event after the last one closed: window_start, in_window and allowed of each event."""

    def step(state: tuple, at: int) -> tuple[tuple, tuple]:
        opened, n = state
        if opened is None or at >= opened + seconds * 1_000_000:
            opened, n = at, 0
        return (opened, n + 1), (opened, n + 1, n < most)

    out = ordered_fold(events, key, ts, tie, (None, 0), step, "opened long, in_window int, allowed boolean")
    return out.select(key, tie, F.timestamp_micros("opened").alias("window_start"), "in_window", "allowed")


def lockouts(attempts: DataFrame, key: str, ts: str, tie: str, most: int = 5, forget: int = 60, lock: int = 900) -> DataFrame:
    """key, tie, allowed: more than so many attempts within forget seconds of the first lock the key for lock seconds."""

    def step(state: tuple, at: int) -> tuple[tuple, tuple]:
        first, n, until = state
        if at < until:
            return state, (False,)
        if n == 0 or at >= first + forget * 1_000_000:
            first, n = at, 0
        n += 1
        if n > most:
            until, n = at + lock * 1_000_000, 0
        return (first, n, until), (at >= until,)

    return ordered_fold(attempts, key, ts, tie, (0, 0, 0), step, "allowed boolean")


def first_seen(events: DataFrame, id_: str, ts: str, tie: str) -> DataFrame:
    """Each event id once, at its first time."""
    w = Window.partitionBy(id_).orderBy(ts, tie)
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def final_states(events: DataFrame, job: str, ts: str, state: str, tie: str, timeout_seconds: int, now: Column) -> DataFrame:
    """Per job: the first final state; without one FAILED after the timeout, else PROCESSING. A second completion changes nothing."""
    order = F.when(F.col(state).isin("COMPLETE", "FAILED"), F.struct(ts, tie))
    jobs = events.groupBy(job).agg(F.min_by(state, order).alias("final"), F.min(ts).alias("started"), F.count_if(F.col(state).isin("COMPLETE", "FAILED")).alias("completions"))
    stale = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp")) > timeout_seconds * 1_000_000
    return jobs.select(job, F.coalesce("final", F.when(stale, "FAILED").otherwise("PROCESSING")).alias("state"), "started", "completions")


def monthly_use(events: DataFrame, key: str, ts: str, tie: str, quota: int) -> DataFrame:
    """Adds used (events of the key in this calendar month so far) and allowed; the count starts anew each month. quota -1: no limit."""
    month = F.date_format(ts, "yyyy-MM")
    w = Window.partitionBy(key, month).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("month", month).withColumn("used", F.count(F.lit(1)).over(w))
    return out.withColumn("allowed", F.lit(True) if quota == -1 else F.col("used") <= quota)


def consume_credits(events: DataFrame, key: str, ts: str, tie: str, grant: int, expires: Column) -> DataFrame:
    """Adds left (credits after this event) and allowed; an event past the expiry consumes nothing."""
    valid = F.col(ts) <= expires
    w = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(valid.cast("int")).over(w)
    return events.withColumn("allowed", valid & (used <= grant)).withColumn("left", F.greatest(F.lit(0), grant - used).cast("long"))


def days_until(deadline: Column, today: Column) -> Column:
    return F.datediff(F.to_date(deadline), F.to_date(today))


def reminder(days: Column, last: Column) -> Column:
    """7d, 3d or 1d on that very day, overdue from the day itself, each only where it was not the last one sent; else null."""
    due = F.when(days <= 0, "overdue").when(days == 1, "1d").when(days == 3, "3d").when(days == 7, "7d")
    return F.when(due.isNotNull() & ~due.eqNullSafe(last), due)


def go_no_go(answers: Column, mandatory: Column) -> tuple[Column, Column]:
    """Score from 0 to 100 and recommendation of an array of points; a mandatory gap overrides the score."""
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate(answers, F.lit(0), lambda a, x: a + x)))
    said = F.when(mandatory == -100, "NO-GO: mandatory gap").when(score >= 75, "STRONG GO").when(score >= 50, "CONDITIONAL GO").when(score >= 25, "LIKELY NO-GO").otherwise("NO-GO")
    return score, said
