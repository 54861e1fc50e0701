"""Runs of words against all periods tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np

from reqloom.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, runs string, best string"


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repeated(rng: random.Random) -> list[int]:
    n, letters = rng.randint(0, 130), rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // rng.randint(1, 6)))
            for i in range(a, min(n, a + p * rng.randint(2, 9))):
                words[i] = words[a + (i - a) % p]
    return words


def test_against_all_periods():
    rng, total = random.Random(3), 0
    for _ in range(1200):
        docs = [repeated(rng) for _ in range(rng.randint(1, 5))]
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = periods.periodic_runs(np.array([w for d in docs for w in d], dtype=np.int64), starts)
        want = [plain_runs(d) for d in docs]
        assert got == want
        total += sum(map(len, want))
    assert total > 2000


def test_nested_and_long():
    """Runs within the period of a run, blocks that all lie in runs of smaller periods, and long plain repetitions."""
    for words in ([*[0] * 100, 1] * 6, ([0, 1, 2] * 21 + [0]) * 5, [0] * 5000, [0, 1] * 2000, ([0] * 6 + [1] * 6) * 40):
        words = np.array(words, dtype=np.int64)
        assert periods.periodic_runs(words, np.array([0, len(words)])) == [plain_runs(words.tolist())]
    zeros = np.zeros(400_000, dtype=np.int64)
    assert periods.periodic_runs(zeros, np.array([0, len(zeros)])) == [[(0, 400_000, 1)]]
    period = np.random.default_rng(2).integers(0, 9, 30_011)
    assert periods.periodic_runs(np.tile(period, 5), np.array([0, 5 * 30_011]))[0][-1] == (0, 5 * 30_011, 30_011) or (0, 5 * 30_011, 30_011) in periods.periodic_runs(np.tile(period, 5), np.array([0, 5 * 30_011]))[0]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    said = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha(said), sha(kept))


def test_query(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(f"w{w}é" for w in repeated(rng)), "x", "y") for i in range(300)]
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, " \n ", "z", "z"), (None, "a a a a a a a", None, None), (None, None, None, None), (5, "a b a b a b a b", None, None), (5, "a b a b a b a b", None, None), (1003, "long " * 20_000, None, None)]
    tenth = [i for i in range(10**6, 10**6 + 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, " ".join(str(rng.randrange(40)) for _ in range(rng.randint(0, 90))), None, None) for i in tenth] + [(i, None, None, None) for i in tenth[:2]]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, periods.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t, *_ in rows), key=repr)
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert periods.op12_periodic_runs(spark, str(tmp_path / "none")).count() == 0
