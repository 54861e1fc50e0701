"""Rows put to a stand-in: results depend on the row alone, whatever calls fail and however rows are dealt."""

import json
import threading

from pyspark.sql import functions as F

from reqloom.operators import asking as A


def stand_in(prompts):
    if any("fail" in p for p in prompts):
        raise TimeoutError("timed out")
    said = {"a": {"type": "STAFFING", "mandatory": False}, "b": {"type": "NO KIND", "mandatory": "yes"}, "c": {}}
    return json.dumps({"r": [{"i": i} | said[p[0]] for i, p in enumerate(prompts) if p[0] in said][::-1] + [{"i": 99}, "odd"]})


def rows(spark):
    data = [(i, t, "PROCEDURAL", True, c) for i, (t, c) in enumerate([("a one", 10), ("b two", 10), ("c three", 69), ("lost", 10), ("fail", 10), ("a sure", 70), (None, 10), ("a unknown", None)] * 9)]
    return spark.createDataFrame(data, "id long, text string, type string, is_mandatory boolean, confidence int")


def test_results_depend_on_the_row_alone(spark):
    want = None
    for tasks, prompts, in_flight in ((1, 10, 3), (5, 1, 1), (3, 7, 4), (2, 100, 2)):
        out = A.refined(rows(spark).repartition(tasks + 1), stand_in, F.col("text"), "id", prompts=prompts, in_flight=in_flight, tasks=tasks, wait=lambda s: None)
        got = sorted(map(tuple, out.select("id", "type", "is_mandatory", "confidence", "answered").collect()))
        want = want or got
        assert got == want and len(got) == 72
    assert [r[1:] for r in want[:8]] == [("STAFFING", False, 95, True), ("PROCEDURAL", True, 95, True), ("PROCEDURAL", True, 95, True), ("PROCEDURAL", True, 10, False), ("PROCEDURAL", True, 10, False), ("PROCEDURAL", True, 70, None), ("PROCEDURAL", True, 10, False), ("STAFFING", False, 95, True)]


def test_calls_in_flight_and_retries():
    waits, calls, now, most, lock = [], [], [0], [0], threading.Lock()

    def flaky(prompts):
        calls.append(len(prompts))
        if len(calls) < 3:
            raise ConnectionError("reset")
        return json.dumps({"r": [{"i": i} for i in range(len(prompts))]})

    assert A.answers(flaky, ["x", "y"], 2, waits.append) == [{"i": 0}, {"i": 1}] and waits == [1.0, 2.0] and calls == [2, 2, 2]

    def barred(prompts):
        calls.append(0)
        raise PermissionError("Invalid API key")

    calls.clear()
    assert A.answers(barred, ["x"], 2, waits.append) == [None] and calls == [0]

    def counted(prompts):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        threading.Event().wait(0.01)
        with lock:
            now[0] -= 1
        return json.dumps({"r": [{"i": i} for i in range(len(prompts))]})

    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda c: A.answers(counted, c, 0, waits.append), [["x"]] * 30))
    assert most[0] <= 3
