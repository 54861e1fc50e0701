"""Places in UTF-16 units against Python's own encoding."""

import random

from pyspark.sql import functions as F

from reqloom.functions import offsets as O


def test_places(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab\n é中\U0001f600\U00010000\U0010ffff") for _ in range(rng.randrange(30))) for _ in range(60)] + ["", "\U0001f600", "\U0001f600\U0001f600x", "plain"]
    units = lambda t, n: len(t[:n].encode("utf-16-be")) // 2
    rows = [(i, t, n) for i, t in enumerate(texts) for n in range(len(t) + 1)]
    df = spark.createDataFrame(rows, "id int, text string, at int")
    wide = O.wide_places(F.col("text"))
    for r in df.select("text", "at", O.to_units(F.col("at"), wide).alias("unit"), O.to_points(O.to_units(F.col("at"), wide), wide).alias("back"), O.to_points(O.to_units(F.col("at"), wide) - 1, wide).alias("before")).collect():
        assert r.unit == units(r.text, r.at) and r.back == r.at and (r.at == 0 or r.before == r.at - 1)
    docs = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    spans = spark.createDataFrame([(i, n, len(texts[i])) for i, _, n in rows] + [(999, 5, 6)], "id int, start int, end int")
    got = sorted(map(tuple, O.spans_in_units(spans, docs, "id", "text", "start", "end").collect()))
    assert got == sorted([(i, units(texts[i], n), units(texts[i], len(texts[i]))) for i, _, n in rows] + [(999, 5, 6)])
    none = spark.createDataFrame([(None,)], "text string")
    assert none.select(O.wide_places(F.col("text"))).first()[0] == []


def test_texts_full_of_wide_letters(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("a\U0001f600\U00010000\uffff") for _ in range(n)) for n in (1, 2, 3, 31, 32, 33, 1000)] + ["\U0001f600" * 64, "a" * 64, ""]
    rows = [(t, at) for t in texts for at in range(0, len(t) + 1, max(1, len(t) // 40))]
    wide = O.wide_places(F.col("text"))
    unit = O.to_units(F.col("at"), F.col("wide"))
    out = spark.createDataFrame(rows, "text string, at int").withColumn("wide", wide).withColumn("unit", unit).withColumn("back", O.to_points(F.col("unit"), F.col("wide")))
    for r in out.collect():
        assert r.wide == [i for i, c in enumerate(r.text) if ord(c) > 0xFFFF] and r.unit == len(r.text[: r.at].encode("utf-16-le")) // 2 and r.back == r.at
