"""Streams with timers and expiring state against their batch forms, over restarts, and the cache against a plain one."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from reqloom.operators import expiring as E
from reqloom.streaming import keyed, timed

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def provider(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timed.prepared(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, df, by, parts, make, where):
    """What make gives over df, whose rows come as files in order of time; the stream is stopped and started again in between."""
    rows = sorted(df.collect(), key=lambda r: r[by])
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], df.schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        if i in (parts // 2, parts - 1):
            source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
            keyed.run_once(make(source), f"{where}/out", f"{where}/check")
    return sorted(map(tuple, spark.read.parquet(f"{where}/out").collect()), key=repr)


def requests(spark, n=400):
    rng = random.Random(6)
    rows = [(i, i % 2, START + datetime.timedelta(seconds=9 * i), f"n{min(rng.randrange(40), rng.randrange(40))}") for i in range(n)]
    return spark.createDataFrame(rows, "tie long, shard long, ts timestamp, name string")


def plain_cache(rows, ttl, capacity):
    """A list of (name, time stored), oldest first, in place of the cache."""
    out, held = [], {}
    for tie, shard, ts, name in rows:
        entries = held.setdefault(shard, [])
        found = [e for e in entries if e[0] == name]
        hit = bool(found) and (ts - found[0][1]).total_seconds() <= ttl
        evicted = 0
        if not hit:
            entries[:] = [e for e in entries if e[0] != name]
            if len(entries) >= capacity:
                evicted = -(-capacity // 4)
                del entries[:evicted]
            entries.append((name, ts))
        out.append((shard, tie, hit, evicted, len(entries)))
    return sorted(out, key=repr)


def test_cache(spark, tmp_path):
    df = requests(spark)
    want = plain_cache(df.orderBy("ts").collect(), 600, 10)
    assert {r[2] for r in want} == {True, False} and any(r[3] for r in want)
    assert sorted(map(tuple, E.cache_lookups(df.repartition(5), "shard", "ts", "tie", "name", 600, 10).collect()), key=repr) == want
    assert streamed(spark, df, "ts", 6, lambda s: timed.cache_lookups(s, "shard", "ts", "tie", "name", 600, 10), str(tmp_path)) == want


def job_events(spark):
    rng, rows = random.Random(8), []
    for job in range(30):
        begun = START + datetime.timedelta(minutes=7 * job)
        rows.append((len(rows), f"j{job}", begun, "PROCESSING"))
        for _ in range(rng.randrange(3)):
            rows.append((len(rows), f"j{job}", begun + datetime.timedelta(minutes=rng.randrange(100), seconds=1), rng.choice(["COMPLETE", "FAILED", "PROCESSING"])))
    rows.append((len(rows), "last", START + datetime.timedelta(hours=9), "PROCESSING"))
    return spark.createDataFrame(rows, "tie long, job string, ts timestamp, state string")


def test_jobs(spark, tmp_path):
    df = job_events(spark)
    want = sorted(map(tuple, E.job_ends(df, "job", "ts", "tie", "state", F.lit(START + datetime.timedelta(hours=9))).collect()), key=repr)
    assert {r[2] for r in want} == {"reported", "timed out"} and len(want) == 30
    assert streamed(spark, df, "ts", 7, lambda s: timed.job_ends(s, "job", "ts", "tie", "state"), str(tmp_path)) == want


def test_attempts(spark, tmp_path):
    rows = [(i, START + datetime.timedelta(seconds=3 * i), i % 6, i % 7 == 3) for i in range(40)] + [(99, START + datetime.timedelta(hours=1), 0, False)]
    df = spark.createDataFrame(rows, "call long, ts timestamp, failures int, fatal boolean")
    want = sorted(map(tuple, E.attempts(df, "call", "ts", "failures", "fatal").collect()), key=repr)
    first = [r for r in want if r[0] == 5]
    assert [r[3] for r in first] == ["again", "again", "again", "given up"] and [(b[2] - a[2]).total_seconds() for a, b in zip(first, first[1:])] == [1, 2, 4]
    assert E.backoff(3, 1000, 10_000) == 8000 and E.backoff(4, 1000, 10_000) == 10_000
    assert streamed(spark, df, "ts", 5, lambda s: timed.attempts(s, "call", "ts", "failures", "fatal"), str(tmp_path)) == want


def test_scheduled_batches_add_nothing_twice(spark, tmp_path):
    df = requests(spark, 50)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        keyed.run_once(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50


def test_many_keys_share_buckets(spark, tmp_path):
    rows = [(i, START + datetime.timedelta(milliseconds=250 * i), i % 6, i % 7 == 3) for i in range(6000)] + [(99_999, START + datetime.timedelta(hours=1), 0, False), (100_000, START + datetime.timedelta(hours=1), 0, False)]
    df = spark.createDataFrame(rows, "call long, ts timestamp, failures int, fatal boolean")
    want = sorted(map(tuple, E.attempts(df, "call", "ts", "failures", "fatal").collect()), key=repr)
    assert streamed(spark, df, "ts", 3, lambda s: timed.attempts(s, "call", "ts", "failures", "fatal"), f"{tmp_path}/calls") == want
    jobs = df.select(F.col("call").alias("tie"), F.concat(F.lit("j"), (F.col("call") % 1500).cast("string")).alias("job"), "ts", F.when(F.col("failures") == 5, "COMPLETE").when(F.col("fatal"), "FAILED").otherwise("PROCESSING").alias("state"))
    last = F.lit(START + datetime.timedelta(hours=1))
    want = sorted(map(tuple, E.job_ends(jobs, "job", "ts", "tie", "state", last, 200).collect()), key=repr)
    assert {r[2] for r in want} == {"reported", "timed out"}
    assert streamed(spark, jobs, "ts", 3, lambda s: timed.job_ends(s, "job", "ts", "tie", "state", 200), f"{tmp_path}/jobs") == want
    assert df.select(timed._bucket("call")).distinct().count() <= timed.BUCKETS < df.count() / 10
