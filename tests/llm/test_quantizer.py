"""Vector codes against Lloyd rounds in plain whole numbers, and against SQL."""

import collections
import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from reqloom.llm import quantizer

SCHEMA = "vec_id long, embedding array<double>, label int, code string, id string, error string"


def expected(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    whole = lambda v: [math.floor(Fraction(x) * 4096) for x in v] + [0] * (size * parts - len(v))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[w[p * size : (p + 1) * size] for p in range(parts)] for w in (whole(v) for _, v, _ in kept)]
    books = [[x[e][p] for e in range(min(entries, len(x)))] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    nearest = lambda p, a: min((far(a, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        after = []
        for p in range(parts):
            groups = collections.defaultdict(list)
            for v in x:
                groups[nearest(p, v[p])[1]].append(v[p])
            after.append([[sum(c) // len(groups[e]) for c in zip(*groups[e])] if groups[e] else books[p][e] for e in range(len(books[p]))])
        books = after
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[nearest(p, v[p]) for p in range(parts)] for v in x]
    errors = [sum(d for d, _ in f) for f in found]
    sums = collections.Counter()
    for (_, _, label), e in zip(kept, errors):
        sums[label] += e
    fit = lambda n: n if n < 1 << 63 else None
    lost = {label for (_, _, label), e in zip(kept, errors) if fit(e) is None}
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), fit(e), None if label in lost else fit(sums[label]), sha) for (i, _, label), f, e in zip(kept, found, errors)), key=repr)


def got(spark, rows, path):
    spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, quantizer.op13_vector_codes(spark, str(path)).collect()), key=repr)


def vectors(n, dims, rng, spread=1.0):
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(12)]
    return [[c + rng.gauss(0, 0.2 * spread) for c in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("spread", [1e-3, 1.0, 1e7, 1e30, 1e306])
def test_components_of_any_size(spark, tmp_path, spread):
    rng = random.Random(4)
    rows = [(i, v, rng.choice([0, 1, 1, 1, None])) for i, v in enumerate(vectors(120, 16, rng, spread))]
    assert got(spark, rows, tmp_path) == expected(rows)


def test_edges(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(200, 24, rng))]
    rows += [(500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 24, 1), (503, [float("inf")] * 24, 2), (504, [], 1), (505, [0.5], None), (None, [0.25] * 24, None), (None, [0.25] * 24, 7)]
    rows += [rows[0], rows[0], (0, [9.0] * 24, 1), *[(600 + i, [0.125] * 24, 5) for i in range(90)]]  # repeated rows, an id twice, many equal vectors
    rng.shuffle(rows)
    assert got(spark, rows, tmp_path) == expected(rows)


def test_few_and_none(spark, tmp_path):
    for name, rows in (("one", [(3, [1.0, 2.0], 1)]), ("three", [(i, [float(i)] * 8, None) for i in range(3)]), ("blank", [(1, [], 2), (2, [], 2)])):
        assert got(spark, rows, tmp_path / name) == expected(rows)
    assert got(spark, [], tmp_path / "none") == [] == got(spark, [(1, None, 2)], tmp_path / "null")


def test_heaps_spare_most_parts():
    """After the first scans the heaps give back few parts, and settling gives what a scan of all gives."""
    rng = np.random.default_rng(1)
    x = np.floor(4096 * (rng.normal(size=(8, 32))[rng.integers(0, 8, 3000)] + rng.normal(scale=0.05, size=(3000, 32))))
    books = quantizer.Codebooks(np.array(x[:16].astype(np.int64).tolist(), dtype=object).reshape(16, 8, 4).transpose(1, 0, 2))
    chunk = quantizer.Chunk(x, 8, 16)
    chunk.scan_all(books)
    counts = []
    for _ in range(8):
        totals = list(map(int, chunk.sums()))
        books = books.moved(totals, totals[8 * 16 * 4 :])
        before = chunk.rescanned
        again = quantizer.Chunk(x, 8, 16)
        again.load(*chunk.saved())
        again.settle(books)
        counts.append(again.rescanned)
        whole = quantizer.Chunk(x, 8, 16)
        whole.scan_all(books)
        assert (again.codes(books)[0] == whole.codes(books)[0]).all() and before >= 0
        chunk = again
    assert counts[-1] < 3000 * 8 / 3


def test_sql(spark):
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.sql(quantizer.OP13_SQL).fetchall()
    columns = [c[0] for c in con.sql(quantizer.OP13_SQL).description]
    found = quantizer.op13_vector_codes(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want)
