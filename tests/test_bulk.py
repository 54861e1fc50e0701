"""Inserts of several tables at once: batches come once, whole, and through restarts and races."""

import threading

import pytest
from pyspark.sql import functions as F

from reqloom.sources import bulk


def tables(spark, n, start=0):
    rows = spark.range(start, start + n)
    return {"requirement": rows.select("id", F.concat(F.lit("text "), "id").alias("text")), "job": rows.where("id % 3 = 0").select("id", F.lit("COMPLETE").alias("status")), "project": rows.limit(0).select(F.col("id").alias("project_id"))}


def counts(spark, path):
    return {t: bulk.bulk_table(spark, path, t).count() for t in ("requirement", "job", "project")}


def test_batches_come_once(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert bulk.bulk_insert(tables(spark, 30), path, "one") and not bulk.bulk_insert(tables(spark, 30), path, "one")
    assert counts(spark, path) == {"requirement": 30, "job": 10, "project": 0}
    assert bulk.bulk_insert(tables(spark, 12, 30), path, "two")
    assert counts(spark, path) == {"requirement": 42, "job": 14, "project": 0}
    more = {"job": spark.range(1).select("id", F.lit("FAILED").alias("status"), F.lit("late").alias("error"))}
    assert bulk.bulk_insert(more, path, "three")
    assert sorted(r.error for r in bulk.bulk_table(spark, path, "job").where("error is not null").collect()) == ["late"]
    for bad in ("../x", "", "a b"):
        with pytest.raises(ValueError):
            bulk.bulk_insert(more, path, bad)
    with pytest.raises(ValueError):
        bulk.bulk_table(spark, path, "none")


def test_a_failed_insert_is_not_seen(spark, tmp_path):
    """The second table's task fails after the first table is written; the next try of the same batch gives one copy."""
    path = f"{tmp_path}/store"
    broken = tables(spark, 30)
    broken["job"] = broken["job"].withColumn("status", F.when(F.col("id") > 20, F.raise_error(F.lit("lost"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="lost"):
        bulk.bulk_insert(broken, path, "one")
    with pytest.raises(ValueError):
        bulk.bulk_table(spark, path, "requirement")
    assert bulk.bulk_insert(tables(spark, 30), path, "one")
    assert counts(spark, path) == {"requirement": 30, "job": 10, "project": 0}
    assert bulk.vacuum(spark, path) == 2 and bulk.vacuum(spark, path) == 0
    assert counts(spark, path) == {"requirement": 30, "job": 10, "project": 0}


def test_a_task_that_is_tried_again(spark, tmp_path):
    """A task that dies at its first attempt, after some rows, leaves no second copy."""
    flag = tmp_path / "died"

    def dying(batches):
        for batch in batches:
            yield batch
        if not flag.exists():
            flag.touch()
            raise RuntimeError("first attempt")

    rows = spark.range(0, 1000, 1, 4).mapInArrow(dying, "id long")
    try:
        done = bulk.bulk_insert({"requirement": rows}, f"{tmp_path}/store", "one")
    except Exception:  # a local master does not try tasks again: the caller does
        done = bulk.bulk_insert({"requirement": rows}, f"{tmp_path}/store", "one")
    assert done and bulk.bulk_table(spark, f"{tmp_path}/store", "requirement").distinct().count() == 1000 == bulk.bulk_table(spark, f"{tmp_path}/store", "requirement").count()


def test_a_race(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda: won.append(bulk.bulk_insert(tables(spark, 30), f"{tmp_path}/store", "one"))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 4 and any(won) and counts(spark, f"{tmp_path}/store")["requirement"] == 30
