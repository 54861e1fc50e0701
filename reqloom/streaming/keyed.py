"""Keyed operators as Structured Streaming queries; each gives what its batch form gives for events in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_events(events: DataFrame, id_: str, ts: str, keep: str = "7 days") -> DataFrame:
    """Each id once; ids are remembered for as long as the watermark reaches back."""
    return events.withWatermark(ts, keep).dropDuplicatesWithinWatermark([id_])


def windowed_counts(events: DataFrame, key: str, ts: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events a key and window, emitted when the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, size, slide)).agg(F.count(F.lit(1)).alias("n"))


def fixed_limit(events: DataFrame, key: str, ts: str, tie: str, seconds: int, most: int) -> DataFrame:
    """key, tie, in_window, allowed: windows open with the first event after the last one closed. State: start and count of the open window."""
    length = pd.Timedelta(seconds=seconds)

    def step(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (None, 0)
        opened = pd.Timestamp(opened, unit="us") if opened is not None else None
        rows = pd.concat(list(frames)).sort_values([ts, tie])
        out = []
        for at, name in zip(rows[ts], rows[tie], strict=True):
            if opened is None or at >= opened + length:
                opened, n = at, 0
            n += 1
            out.append((_key[0], name, n, n <= most))
        state.update((int(opened.value // 1000) if opened.unit == "ns" else int(opened.timestamp() * 1e6), n))
        yield pd.DataFrame(out, columns=[key, tie, "in_window", "allowed"])

    return events.select(key, ts, tie).groupBy(key).applyInPandasWithState(step, f"{key} long, {tie} long, in_window int, allowed boolean", "opened long, n int", "append", GroupStateTimeout.NoTimeout)


def lockouts(attempts: DataFrame, key: str, ts: str, tie: str, most: int = 5, forget: int = 60, lock: int = 900) -> DataFrame:
    """key, tie, allowed: more than so many attempts within forget seconds of the first lock the key for lock seconds."""

    def step(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n, until = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames)).sort_values([ts, tie])
        out = []
        for at, name in zip((t.timestamp() for t in rows[ts]), rows[tie], strict=True):
            if at < until:
                out.append((_key[0], name, False))
                continue
            if n == 0 or at >= first + forget:
                first, n = at, 0
            n += 1
            if n > most:
                until, n = at + lock, 0
            out.append((_key[0], name, at >= until))
        state.update((float(first), n, float(until)))
        yield pd.DataFrame(out, columns=[key, tie, "allowed"])

    return attempts.select(key, ts, tie).groupBy(key).applyInPandasWithState(step, f"{key} long, {tie} long, allowed boolean", "first double, n int, until double", "append", GroupStateTimeout.NoTimeout)


def job_states(events: DataFrame, job: str, ts: str, state_column: str, late: str = "1 hour") -> DataFrame:
    """First final state of each job, once; a second completion is dropped."""
    final = events.where(F.col(state_column).isin("COMPLETE", "FAILED"))
    return final.withWatermark(ts, late).dropDuplicatesWithinWatermark([job])


def run_once(df: DataFrame, path: str, checkpoint: str):
    """All that is there now, added to a Parquet table: the form of scheduled batches. The table's log of committed files makes a repeated run add nothing twice."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
