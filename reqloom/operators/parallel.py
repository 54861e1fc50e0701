"""Extraction from one document by many tasks.

A text is cut into pieces that overlap. A piece's task finds every place of its own part where a pattern matches, whether or
not an earlier match covers it; as a pattern at a place reads at most a few lines on, the overlap of LINES lines that hold
something makes that exact. What depends on matches accepted before, that is, matches without overlap, spacing, ranges of
numbers, runs in an Arrow stream over the places in order, without the text: events of one document are small rows. Texts
of spans are put together again from the pieces that they touch. Rows are the same as those of a whole document's scan.

Chunks for extraction are planned the same way: boundaries are accepted places, a section ends where the next begins (lead),
short sections join the one before (a running sum over long ones). Sizes come from breaks found once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqloom.functions.families import CHUNK_HEADINGS, FAMILIES, HEADINGS, SPLIT_HEADING
from reqloom.functions.signs import Signs
from reqloom.functions.text import strip
from reqloom.operators import extraction as X

PIECE, BEFORE, LINES = 16_384, 512, 12
HIT, HEADING, MARK, EDGE = range(4)
PIECES = "doc_id long, piece int, offset long, begins long, ends long, length long, text string"
EVENT = "doc_id long, length long, kind int, family int, nth int, start long, end long, at long, label string, major string, barred boolean"

#: (kind, family, number of the pattern, pattern) of all that a scan for requirements looks for, and of what chunking looks for.
SCANNED = [(HIT, f, i, p) for f, (_, _, hits, _) in enumerate(FAMILIES) for i, p in enumerate(hits)] + [(HEADING, 0, i, p) for i, p in enumerate(HEADINGS)] + [(MARK, f, i, m[0]) for f, (_, _, _, marks) in enumerate(FAMILIES) for i, m in enumerate(marks)]
EDGES = [(EDGE, 0, i, p) for i, p in enumerate([*CHUNK_HEADINGS, SPLIT_HEADING])]
_LINE = re.compile(r"[^\n]*\S[^\n]*(?:\n|\Z)")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def overlapping(text: str, size: int = PIECE) -> Iterator[tuple[int, int, int, int, str]]:
    """(number, start of the piece, start and end of its own part, text of the piece)."""
    for number, begins in enumerate(range(0, max(len(text), 1), size)):
        ends = min(begins + size, len(text))
        until = ends
        for _ in range(LINES):
            line = _LINE.search(text, until)
            until = line.end() if line else len(text)
        offset = max(0, begins - BEFORE)
        yield number, offset, begins, ends, text[offset:until]


def pieces(docs: DataFrame, size: int = PIECE) -> DataFrame:
    """Pieces of each text, dealt over all tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = text.as_py() or ""
                yield _batch([(doc, n, offset, begins, ends, len(whole), part) for n, offset, begins, ends, part in overlapping(whole, size)], PIECES)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES).repartition(n, "doc_id", "piece")


def places(text: str, lo: int, hi: int, groups: list[tuple]) -> Iterator[tuple]:
    """(kind, family, nth, match) of every place in text[lo:hi] where one of the patterns matches."""
    signs = Signs(text)
    for kind, family, nth, p in groups:
        for m in signs.everywhere(p, lo, hi):
            yield kind, family, nth, m


def event(kind: int, family: int, nth: int, m: re.Match) -> tuple[int, str | None, str | None, bool]:
    """(place of the sign itself, label, major section or title, whether it is a version or a date) of a match."""
    at, label, major, barred = m.start() + len(m[0]) - len(m[0].lstrip()), None, None, False
    if kind == HEADING:
        label, major = m[1], X.heading_title(m[2])
    elif kind == MARK:
        _, major_of, label_of, _ = FAMILIES[family][3][nth]
        label, major = X.filled(label_of, m.groups()), X.filled(major_of, m.groups())
        barred = bool(X.VERSION.search(m.string[max(0, at - 15) : at].lower()) or X.DATE.match(label))
    elif kind == EDGE:
        at, label, major = m.start(), m[1].strip(), re.sub(r"[.:\-,]+$", "", m[2].strip())[:60]
    return at, label, major, barred


def events(parts: DataFrame, groups: list[tuple]) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                o, rows = row["offset"], []
                for kind, family, nth, m in places(row["text"], row["begins"] - o, row["ends"] - o, groups):
                    at, label, major, barred = event(kind, family, nth, m)
                    rows.append((row["doc_id"], row["length"], kind, family, nth, m.start() + o, m.end() + o, at + o, label, major, barred))
                yield _batch(rows, EVENT)

    return parts.mapInArrow(scan, EVENT)


def apart(found: Iterable[tuple]) -> Iterator[tuple]:
    """Of places in order (kind, family, nth, start, end, ...), those that a search going on behind each match would find."""
    for _, same in groupby(found, key=lambda e: e[:3]):
        until = -1
        for e in same:
            if e[3] >= until:
                until = e[4]
                yield e


def folded(found: DataFrame, fold: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What fold makes of each document's places in order; doc_id and length come first. Places stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (doc, length), mine in groupby(rows, key=lambda r: r[:2]):
            yield _batch([(doc, length, *row) for row in fold(apart(r[2:] for r in mine))], full)

    full = f"doc_id long, length long, {schema}"
    dealt = found.repartition("doc_id").sortWithinPartitions("doc_id", "length", "kind", "family", "nth", "start")
    return dealt.mapInArrow(run, full)


def accepted(found: Iterable[tuple]) -> list[tuple]:
    """(at, begins, label, major, priority, family) of the marks that hold, in order of position."""
    counts, majors, waiting = [0] * len(FAMILIES), set(), [[] for _ in FAMILIES]
    for kind, family, nth, _, end, at, label, major, barred in found:
        if kind == HIT:
            counts[family] += 1
        elif kind == MARK:
            waiting[family].append((nth, at, end, label, major, barred))
        elif len(major) >= 3 and not major.isdigit():
            majors.add(label)
    present = sorted((f for f, (_, least, *_) in enumerate(FAMILIES) if counts[f] >= least), key=lambda f: -counts[f])
    marks = X.Marks()
    for f in present or [0]:
        name, _, _, table = FAMILIES[f]
        for nth, at, end, label, major, barred in waiting[f]:
            priority = table[nth][3]
            if marks.near(at, label, priority):
                continue
            if name == "numeric" and priority < 100:
                if major not in majors or barred or (marks.low is not None and not marks.low - 1 <= int(major) <= marks.high + 3):
                    continue
            marks.add(at, end, label, major, priority, name)
    return sorted(marks.rows, key=lambda r: r[:2])


def marks(docs: DataFrame, size: int = PIECE) -> DataFrame:
    """doc_id, length (of the text), place (in order), at, begins, label, major, priority, family."""
    fold = lambda found: [(i, *row) for i, row in enumerate(accepted(found))]
    return folded(events(pieces(docs, size), SCANNED), fold, "place int, at long, begins long, label string, major string, priority int, family string")


def texts_of(docs: DataFrame, spans: DataFrame, size: int = PIECE) -> DataFrame:
    """spans (doc_id, place, begins, until, ...) with text, put together from the pieces that each touches."""
    own = pieces(docs, size).select("doc_id", "piece", F.col("begins").alias("lo"), F.expr("substring(text, cast(begins - offset + 1 as int), cast(ends - begins as int))").alias("own"))
    touched = spans.select("doc_id", "place", "begins", "until", F.explode(F.sequence(F.floor(F.col("begins") / size).cast("int"), F.floor(F.greatest("begins", F.col("until") - 1) / size).cast("int"))).alias("piece"))
    part = F.expr("substring(own, cast(greatest(begins - lo, 0) + 1 as int), cast(until - greatest(begins, lo) as int))")
    parts = touched.join(own, ["doc_id", "piece"]).groupBy("doc_id", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", part.alias("said")))), lambda x: x["said"]), "").alias("text"))
    return spans.join(parts, ["doc_id", "place"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def candidates(docs: DataFrame, size: int = PIECE) -> DataFrame:
    """As extraction.candidates: doc_id, label, text, start, end, major, family."""
    end = F.coalesce(F.lead("at").over(Window.partitionBy("doc_id").orderBy("place")), F.least(F.col("begins") + X.LAST_CHARS, F.col("length")))
    spans = marks(docs, size).withColumn("end", end).withColumn("until", F.greatest("begins", "end"))
    cut = texts_of(docs, spans, size).select("doc_id", "label", F.explode(F.array(X.cleaned(F.col("text")))).alias("text"), F.col("at").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "major", "family")
    return cut.where(~X.junk(F.col("text")))


def spaced(found: Iterable[tuple]) -> list[tuple]:
    """(at, number, title) of section starts: 20 characters from each other, those over two lines 50; the first of each number."""
    taken: list[int] = []
    first: dict[str, tuple] = {}
    for _, _, nth, _, _, at, number, title, _ in found:
        room = 50 if nth == len(CHUNK_HEADINGS) else 20
        if len(title) < 5 or taken[bisect_right(taken, at - room) : bisect_left(taken, at + room)]:
            continue
        insort(taken, at)
        if number not in first or first[number][0] > at:
            first[number] = (at, number, title)
    return sorted(first.values())


def section_chunks(docs: DataFrame, size: int = PIECE) -> DataFrame:
    """doc_id, chunk, start, end, number, title: sections of documents that have two of them, and two chunks, or more; short ones join the one before."""
    edges = folded(events(pieces(docs, size), EDGES), lambda found: rows if len(rows := spaced(found)) > 1 else [], "at long, number string, title string")
    order = Window.partitionBy("doc_id").orderBy("at")
    spans = edges.withColumn("place", F.row_number().over(order)).withColumn("until", F.coalesce(F.lead("at").over(order), "length"))
    intro = spans.where((F.col("place") == 1) & (F.col("at") > X.SECTION_CHARS)).select("doc_id", "length", F.lit(0).cast("long").alias("at"), F.lit("0").alias("number"), F.lit("Introduction").alias("title"), F.lit(0).alias("place"), F.col("at").alias("until"))
    said = texts_of(docs, spans.unionByName(intro).withColumn("begins", F.col("at")), size)
    short = F.length(strip(F.col("text"))) < X.SECTION_CHARS
    # The text before the first section counts only if it is long; the first section stands whatever its length.
    rows = said.select("doc_id", "place", "at", "until", "number", "title", (~short | (F.col("place") == 1)).alias("opens"), short.alias("short")).where("place > 0 or not short")
    island = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("doc_id").orderBy("place"))
    chunks = rows.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("at").alias("start"), F.max("until").alias("end"), F.min_by("number", "place").alias("number"), F.min_by("title", "place").alias("title"))
    count = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return chunks.withColumn("n", count).where("n > 1").select("doc_id", (F.col("island") - 1).cast("int").alias("chunk"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "number", "title")


SUBSECTION, REQUIREMENT = re.compile(r"\s\d+\.\d+\s+[A-Z]"), re.compile(r"\s\d+\.\d+\.\d+\s")


def line_breaks(text: str, number: re.Pattern) -> list[tuple[int, int, int]]:
    """(first break, last break, end) of each number that stands behind white space with a line break in it."""
    out = []
    for m in number.finditer(text):
        lo = m.start() + 1
        while lo and text[lo - 1].isspace():
            lo -= 1
        space = text[lo : m.start() + 1]
        if "\n" in space:
            out.append((lo + space.index("\n"), lo + space.rindex("\n"), m.end()))
    return out


def nearest(breaks: list[tuple[int, int, int]], goal: int, reach: int) -> int | None:
    """The break closest to the goal, nearer than reach but not on it; each stands at its first place inside the reach."""
    low = max(0, goal - reach)
    inside = breaks[bisect_left(breaks, low, key=lambda b: b[1]) : bisect_right(breaks, goal + reach, key=lambda b: b[2])]
    found = min(((abs(at - goal), at) for first, last, _ in inside if (at := max(first, low)) <= last), default=None)
    return found[1] if found and 0 < found[0] < reach else None


def size_edges(text: str) -> list[int]:
    """Ends of chunks of about CHUNK_CHARS: at a subsection near by, else at a requirement, else at a paragraph."""
    kinds = [line_breaks(text, SUBSECTION), line_breaks(text, REQUIREMENT)]
    paragraphs, edges = [m.start() for m in re.finditer("\n(?=\n)", text)], [0]
    while edges[-1] < len(text):
        goal = edges[-1] + X.CHUNK_CHARS
        if goal >= len(text):
            edges.append(len(text))
            continue
        near = next((at for b in kinds if (at := nearest(b, goal, X.SEARCH)) is not None), None)
        if near is None:
            k = bisect_left(paragraphs, goal - 500)
            near = paragraphs[k] if k < len(paragraphs) and paragraphs[k] < goal + 500 else goal
        edges.append(max(near, edges[-1] + 1))
    return edges


def size_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk, start, end, number, title: by size. The edges follow from each other, so a document is one row here."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = text.as_py() or ""
                edges = size_edges(whole)
                yield _batch([(doc, a, b, whole[a:b]) for a, b in zip(edges, edges[1:])], "doc_id long, start int, end int, said string")

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, start int, end int, said string").where(F.length(strip(F.col("said"))) > 0)
    part = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    number = F.coalesce(F.nullif(F.regexp_extract("said", r"\b(\d+)\.\d+", 1), F.lit("")), F.col("part").cast("string"))
    rows = parts.withColumn("part", part).withColumn("number", number)
    return rows.select("doc_id", (F.col("part") - 1).alias("chunk"), "start", "end", "number", F.concat(F.lit("Section "), "number", F.lit(" (Part "), F.col("part").cast("string"), F.lit(")")).alias("title"))


def planned_chunks(docs: DataFrame, size: int = PIECE) -> DataFrame:
    """As extraction.chunks: small documents whole, others by sections, where these give two chunks at least, or by size. docs: one row a doc_id."""
    numbers = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b\d+\.\d+\.\d+\b"), F.lit(0))))
    questions = F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit("")))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    small = (F.length("text") < X.SMALL_CHARS) & (numbers + F.floor(questions / 3) < X.DENSE)
    whole = known.where(small).select("doc_id", F.lit(0).alias("chunk"), F.lit("none").alias("method"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("full").alias("number"), F.lit("Full Document").alias("title"))
    large = known.where(~small)
    sections = section_chunks(large, size).withColumn("method", F.lit("sections"))
    by_size = size_chunks(large.join(sections.select("doc_id").distinct(), "doc_id", "left_anti")).withColumn("method", F.lit("size"))
    return whole.unionByName(sections).unionByName(by_size)
