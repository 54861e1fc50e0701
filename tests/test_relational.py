"""Near-dedup and interval anti-joins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from reqloom.operators import relational as J


def texts(seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(40)]
    base = [rng.sample(words, 12) for _ in range(6)]
    out = []
    for i in range(150):
        said = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            said[rng.randrange(len(said))] = rng.choice(words)
        out.append((i // 75, f"id{i:03d}" if seed % 2 else i, " ".join(said).upper() if rng.random() < 0.3 else " ".join(said)))
    return out + [(0, "x1" if seed % 2 else 900, "a b"), (0, "x2" if seed % 2 else 901, None), (1, "x3" if seed % 2 else 902, "a b")]


def words_of(text):
    return {w for w in (text or "").lower().split() if len(w) > 2}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("least", [0.6, 0.8, 1.0])
def test_near_dedup(spark, seed, least):
    rows = texts(seed)
    df = spark.createDataFrame(rows, f"g int, id {'string' if seed % 2 else 'long'}, text string").repartition(5)
    like = lambda s, t: bool(s and t) and len(s & t) / len(s | t) > least
    kept = []
    for g, i, t in sorted(rows, key=lambda r: (r[0], r[1])):
        if not any(g == h and like(words_of(t), words_of(u)) for h, _, u in kept):
            kept.append((g, i, t))
    assert sorted(r.id for r in J.keep_first_unlike(df, "g", "id", "text", least).collect()) == sorted(i for _, i, _ in kept)
    pairs, members = J.alike_texts(df, "g", "id", "text", least)
    held = {(r.g, r.id): r.set for r in members.collect()}
    alike = {(r.g, r.a, r.b) for r in pairs.collect()}
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    for x, (g, i, t) in enumerate(ordered):
        assert ((g, i) in held) == bool(words_of(t))
        for h, j, u in ordered[x + 1 :]:
            if g == h and words_of(t) and words_of(u):
                a, b = sorted((held[g, i], held[h, j]))
                assert (a == b) == (words_of(t) == words_of(u)) and (a == b or ((g, a, b) in alike) == like(words_of(t), words_of(u)))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_any_size(spark, seed):
    df = spark.createDataFrame(texts(seed) + [(None, "x4" if seed % 2 else 903, "word1 word2")], f"g int, id {'string' if seed % 2 else 'long'}, text string").repartition(5)
    for least in (0.6, 0.9):
        pairs = [sorted(map(tuple, J.jaccard_pairs(df, "g", "id", "text", least, small=n).collect())) for n in (1000, 76, 0)]
        kept = [sorted(r.id for r in J.keep_first_unlike(df, "g", "id", "text", least, small=n).collect()) for n in (1000, 76, 0)]
        assert pairs[0] and pairs[0] == pairs[1] == pairs[2] and kept[0] == kept[1] == kept[2]


def test_small_groups_need_no_joins_of_words(spark):
    df = spark.createDataFrame([(g, i, f"one two three four{i % 3}") for g in range(20) for i in range(5)], "g int, id long, text string")
    out = J.jaccard_pairs(df, "g", "id", "text", 0.6)
    assert out.count() == 40
    large = J.by_size(df, "g", J.SMALL)[1]
    assert large.count() == 0 and J.by_size(df, "g", 4)[1].count() == 100


@pytest.mark.parametrize("bin_rows", [1, 7, 100_000])
def test_outside_intervals(spark, bin_rows):
    rng = random.Random(bin_rows)
    points = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(-50, 300)])) for i in range(400)]
    spans = [(rng.choice([1, 1, 2, None]), a := rng.randrange(-60, 300), rng.choice([a + rng.choice([-3, 0, 1, 5, 5, 90]), None])) for _ in range(60)]
    p = spark.createDataFrame(points, "name int, key long, at long").repartition(3)
    s = spark.createDataFrame(spans, "key long, start long, end long")
    want = sorted(i for i, k, x in points if not any(k == h and x is not None and b is not None and a <= x <= b for h, a, b in spans if k is not None))
    out = J.outside_intervals(p, s, "key", bin_rows=bin_rows)
    assert out.columns == p.columns and sorted(r.name for r in out.collect()) == want
    assert J.outside_intervals(p, s.limit(0), "key").count() == 400 and J.outside_intervals(p.limit(0), s, "key").count() == 0
    times = lambda df, *cs: df.withColumns({c: F.timestamp_seconds(c) for c in cs})
    assert sorted(r.name for r in J.outside_intervals(times(p, "at"), times(s, "start", "end"), "key", bin_rows=bin_rows).collect()) == want
