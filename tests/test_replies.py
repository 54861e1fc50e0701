"""Worker replies: checks, defaults, dead letters, and restarts from the offset."""

import json
import shutil

from pyspark.sql import functions as F

from reqloom.sources import bulk, replies


def line(project, *rows, **more):
    return json.dumps({"project_id": project, "requirements": list(rows)} | more)


GOOD = [line(1, {"text": "a", "section": "1.1", "type": "STAFFING", "isMandatory": False, "domainContext": "LEGAL"}, {"text": "b", "section": "", "sectionGroup": None}), line(2), line(3, {"text": " c "}, extra=5)]
BAD = {"no json": "no reply", "": "no reply", '{"project_id": 4, "requirements": "x"}': "no reply", '{"project_id": "x"}': "no reply", '{"requirements": []}': "no project", '{"project_id": 5}': "no requirements", line(6, {"text": "fine"}, {"text": "  "}): "requirement without text", line(7, {"section": "1"}): "requirement without text", line(8, status="error"): "worker failed", "[1]": None, line(9)[:-4]: "no reply"}


def test_checks_and_defaults(spark):
    tables = replies.reply_tables(spark.createDataFrame([(v,) for v in [*GOOD, *BAD]], "value string"))
    got = sorted(map(tuple, tables["requirement"].collect()))
    assert got == [(1, 0, "a", "1.1", None, "STAFFING", False, "LEGAL", True, "UNANSWERED"), (1, 1, "b", None, None, "DESCRIPTIVE", True, "FEATURE", False, "UNANSWERED"), (3, 0, " c ", None, None, "DESCRIPTIVE", True, "FEATURE", False, "UNANSWERED")]
    assert sorted(map(tuple, tables["job"].collect())) == [(1, "COMPLETE", 2), (2, "COMPLETE", 0), (3, "COMPLETE", 1)]
    dead = {r.value: r.reason for r in tables["dead_letter"].collect()}
    assert dead.keys() == BAD.keys() and all(dead[v] == r for v, r in BAD.items() if r)


def test_restart(spark, tmp_path):
    where, store = f"{tmp_path}/in", f"{tmp_path}/store"
    stream = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(where)
    put = lambda lines: spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.mode("append").text(where)
    counts = lambda: {t: bulk.bulk_table(spark, store, t).count() for t in ("requirement", "job", "dead_letter")}
    put(GOOD[:1])
    put(list(BAD)[2:])
    replies.ingest(stream(), store, f"{tmp_path}/check", "worker")
    first = counts()
    assert first == {"requirement": 2, "job": 1, "dead_letter": 9}
    shutil.copytree(f"{tmp_path}/check", f"{tmp_path}/before")
    put(GOOD[1:])
    replies.ingest(stream(), store, f"{tmp_path}/check", "worker")
    assert counts() == {"requirement": 3, "job": 3, "dead_letter": 9}
    replies.ingest(stream(), store, f"{tmp_path}/before", "worker")  # a crash after the insert and before the checkpoint's note of it
    assert counts() == {"requirement": 3, "job": 3, "dead_letter": 9}
    assert bulk.bulk_table(spark, store, "job").select(F.sum("requirements")).first()[0] == 3
