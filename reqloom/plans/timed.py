"""Queries of expiring state, in batch form and as streams over the same events, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.operators import expiring as E
from reqloom.session import shared_dir
from reqloom.streaming import keyed, timed

TTL, ENTRIES, SHARDS = 86_400, 50, 8


def events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Events as requests of a cache, as reports of jobs (one for each user and day) and as calls."""
    read = spark.read.parquet(f"{sf_dir}/events.parquet")
    if stream:
        read = spark.readStream.schema(read.schema).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern, a file may stand where a folder is expected
    state = F.when(F.col("event_id") % 5 == 0, "COMPLETE").when(F.col("event_id") % 7 == 0, "FAILED").otherwise("PROCESSING")
    name = F.concat_ws(":", "event_type", "user_id")
    return read.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), state.alias("state"), F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("job"), name.alias("name"), F.pmod(F.crc32(name.cast("binary")), F.lit(SHARDS)).alias("shard"),
        (F.col("event_id") % 6).cast("int").alias("failures"), (F.col("event_id") % 7 == 3).alias("fatal"),
    )


def last_time(spark: SparkSession, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]


def ended(rows: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that is there now."""
    spark = rows.sparkSession
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    keyed.run_once(rows, f"{where}/out", f"{where}/check")
    return spark.read.schema(rows.schema).parquet(f"{where}/out")


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, evictions and sizes of a cache in eight shards, by request."""
    return E.cache_lookups(events(spark, sf_dir), "shard", "ts", "event_id", "name", TTL, ENTRIES).withColumnRenamed("tie", "event_id")


def cache_hits_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed.prepared(spark)
    return ended(timed.cache_lookups(events(spark, sf_dir, True), "shard", "ts", "event_id", "name", TTL, ENTRIES), "cache").withColumnRenamed("tie", "event_id")


def job_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each job ends: by the first report within an hour of its start, or out of time."""
    return E.job_ends(events(spark, sf_dir), "job", "ts", "event_id", "state", F.lit(last_time(spark, sf_dir)))


def job_timeouts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed.prepared(spark)
    return ended(timed.job_ends(events(spark, sf_dir, True), "job", "ts", "event_id", "state"), "jobs")


TIMEOUT_SQL = """with e as (select event_id, ts, user_id || '-' || strftime(ts, '%Y%m%d') as job, case when event_id % 5 = 0 then 'COMPLETE' when event_id % 7 = 0 then 'FAILED' else 'PROCESSING' end as state from events),
j as (select job, min(ts) + interval 1 hour as due, min({'at': ts, 'tie': event_id, 'state': state}) filter (state <> 'PROCESSING') as first from e group by job),
t as (select job, due, first, coalesce(first.at <= due, false) as told from j)
select job, case when told then first.state else 'FAILED' end as state, case when told then 'reported' else 'timed out' end as why, case when told then first.at else due end as at from t where told or due < (select max(ts) from events)"""


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt of each call, up to the time of the last event."""
    return E.attempts(events(spark, sf_dir), "event_id", "ts", "failures", "fatal").where(F.col("at") <= F.lit(last_time(spark, sf_dir)))


def retry_schedule_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed.prepared(spark)
    return ended(timed.attempts(events(spark, sf_dir, True), "event_id", "ts", "failures", "fatal"), "attempts")


RETRY_SQL = """with c as (select event_id as call, date_trunc('milliseconds', ts) as begun, event_id % 6 as failures, event_id % 7 = 3 as fatal from events),
n as (select *, unnest(range(0, case when fatal then 1 else least(failures, 3) + 1 end)) as attempt from c)
select call, attempt::int as attempt, "at", case when attempt >= failures then 'done' when fatal or attempt >= 3 then 'given up' else 'again' end as outcome
from (select *, begun + to_milliseconds(([0, 1000, 3000, 7000])[attempt + 1]) as "at" from n) where "at" <= (select max(ts) from events)"""

QUERIES = {
    "cache_hits": (cache_hits, None),
    "cache_hits_stream": (cache_hits_stream, None),
    "job_timeouts": (job_timeouts, TIMEOUT_SQL),
    "job_timeouts_stream": (job_timeouts_stream, TIMEOUT_SQL),
    "retry_schedule": (retry_schedule, RETRY_SQL),
    "retry_schedule_stream": (retry_schedule_stream, RETRY_SQL),
}
