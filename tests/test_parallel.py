"""Extraction by many tasks to a document against the scan of whole documents, and chunks against a plain reading of the rules."""

import random
import re

import pytest

from reqloom.functions.families import CHUNK_HEADINGS, SPLIT_HEADING
from reqloom.operators import extraction as X
from reqloom.operators import parallel as P

LINES = [
    "3.1.1 Provide search of all records now", "4.2 Reporting of results", "1.0 Introduction", "2.0: Scope of Work", "Section 5: Security Needs", "II.A.3 roman text here that is asked", "III. Title words",
    "A.1.2 Letter text of some length", "B.3 Something else is asked", "C4. Letter number asked for", "[Col 1] D5. | [Col 2] cell of a table", "(1) First thing that is asked", "(b) Second thing that is asked", "(iv) Third thing",
    "3) Fourth Item is asked", "a. outline Item is asked", "ii. Outline two is asked", "[REQ-12] Bracket is asked", "[R3] Short one is asked", "REQ-9: text of a request", "[3.4] odd", "", " ", "   \n", "plain text that goes on and on.",
    "Really? 4) Item ends. (7) Next one! a. Thing", "version 3.1.2 of it", "10.12.2024 date", "6\n\nMajor Heading Title", "7 SPECIAL CONDITIONS", "A. Company Profile", "# B. DELIVERY TERMS", "What is 5.6.7 about?", "x" * 900, "\n\n\n", "é\U0001f600 3.1.4 wide",
]


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 120))) * rng.choice([1, 1, 1, 9]) for _ in range(n)]


def scanned(text: str, size: int, groups: list) -> list[tuple]:
    found = []
    for _, o, lo, hi, part in P.overlapping(text, size):
        for kind, family, nth, m in P.places(part, lo - o, hi - o, groups):
            at, *rest = P.event(kind, family, nth, m)
            found.append((kind, family, nth, m.start() + o, m.end() + o, at + o, *rest))
    return sorted(found, key=lambda e: e[:4])


@pytest.mark.parametrize("size", [90, 1000, P.PIECE])
def test_marks_of_pieces(size):
    for text in texts(60, size):
        assert P.accepted(P.apart(scanned(text, size, P.SCANNED))) == sorted(X.marks_of(text), key=lambda r: r[:2])


def plain_edges(text: str) -> list[tuple]:
    taken, found = [], {}
    for room, p in [*[(20, p) for p in CHUNK_HEADINGS], (50, SPLIT_HEADING)]:
        for m in X.pattern(p).finditer(text):
            title = re.sub(r"[.:\-,]+$", "", m[2].strip())[:60]
            if len(title) >= 5 and all(abs(m.start() - t) >= room for t in taken):
                taken.append(m.start())
                found.setdefault(m[1].strip(), []).append((m.start(), m[1].strip(), title))
    return sorted(min(rows) for rows in found.values())


def plain_break(text: str, goal: int) -> int:
    low = max(0, goal - 2000)
    window = text[low : goal + 2000]
    for p in (r"\n\s*\d+\.\d+\s+[A-Z]", r"\n\s*\d+\.\d+\.\d+\s"):
        apart = [(abs(low + m.start() - goal), low + m.start()) for m in re.finditer(p, window)]
        if apart and 0 < min(apart)[0] < 2000:
            return min(apart)[1]
    at = text.find("\n\n", goal - 500)
    return at if -1 < at < goal + 500 else goal


def plain_chunks(text: str) -> list[tuple]:
    """(method, start, end, number), in order."""
    if len(text) < 50_000 and len(set(re.findall(r"\b\d+\.\d+\.\d+\b", text))) + text.count("?") // 3 < 60:
        return [("none", 0, len(text), "full")]
    edges = plain_edges(text)
    ends = [e[0] for e in edges[1:]] + [len(text)]
    chunks = []
    for (at, number, _), end in zip(edges, ends):
        if chunks and len(text[at:end].strip()) < 500:
            chunks[-1] = (*chunks[-1][:2], end, chunks[-1][3])
        else:
            chunks.append(("sections", at, end, number))
    if chunks and chunks[0][1] > 500 and len(text[: chunks[0][1]].strip()) >= 500:
        chunks.insert(0, ("sections", 0, chunks[0][1], "0"))
    if len(edges) >= 2 and len(chunks) >= 2:
        return chunks
    out, start = [], 0
    while start < len(text):
        goal = start + 15_000
        end = max(plain_break(text, goal), start + 1) if goal < len(text) else len(text)
        part = text[start:end].strip()
        if part:
            m = re.search(r"\b(\d+)\.\d+", part)
            out.append(("size", start, end, m[1] if m else str(len(out) + 1)))
        start = end
    return out


@pytest.fixture(scope="module")
def docs(spark):
    filler = "no numbers here, only words. " * 40
    some = texts(24, 7) + [None, "", "x" * 60_000, ("word " * 900 + "\n\n") * 14, "\n".join(f"{i}. Title Words Here\n{filler}" for i in range(60)), filler * 60 + "\n1. Only One Head\n" + filler, "\n".join(f"3.{i}.1 {filler}" for i in range(50)), "\n".join(f"\n 3.{i} Part\n{filler}" for i in range(50)), "a\n\n" * 20_000]
    return spark.createDataFrame([(i, t, "more") for i, t in enumerate(some)], "doc_id long, text string, label string").repartition(4).cache()


def test_candidates(docs):
    want = sorted(map(tuple, X.candidates(docs).collect()))
    assert len(want) > 200
    for size in (700, P.PIECE):
        assert sorted(map(tuple, P.candidates(docs, size).select(*X.candidates(docs).columns).collect())) == want


def test_chunks(docs):
    want = {r.doc_id: plain_chunks(r.text or "") for r in docs.collect()}
    assert {c[0] for rows in want.values() for c in rows} == {"none", "sections", "size"}
    for size in (5000, P.PIECE):
        got: dict = {}
        for r in P.planned_chunks(docs, size).orderBy("doc_id", "chunk").collect():
            assert r.chunk == len(got.setdefault(r.doc_id, []))
            got[r.doc_id].append((r.method, r.start, r.end, r.number))
        assert got == want


def test_size_edges():
    for text in texts(150, 3):
        edges = [0]
        while edges[-1] < len(text):
            goal = edges[-1] + X.CHUNK_CHARS
            edges.append(max(plain_break(text, goal), edges[-1] + 1) if goal < len(text) else len(text))
        assert P.size_edges(text) == edges


def test_hand_made(spark):
    long = "".join(f"{i}. Title Words Here\n{'word ' * 2000}\n" for i in range(1, 8))
    rows = P.planned_chunks(spark.createDataFrame([(1, "short"), (2, long), (3, "x" * 60_000)], "doc_id long, text string")).orderBy("doc_id", "chunk").collect()
    assert [(r.doc_id, r.number) for r in rows if r.doc_id < 3] == [(1, "full"), *[(2, str(i)) for i in range(1, 8)]]
    assert [(r.start, r.end) for r in rows if r.doc_id == 3] == [(0, 15_000), (15_000, 30_000), (30_000, 45_000), (45_000, 60_000)]
    assert rows[1].title == "Title Words Here" and rows[-1].title == "Section 4 (Part 4)"
