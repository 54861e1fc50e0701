r"""Runs of words that repeat with a period, by block matching.

A run is a stretch of consecutive words with smallest period q and length >= max(LEAST, TIMES * q) that cannot be extended
without losing the period. Of a run with B <= q < 2B, B a power of two, some block of B words that begins at a multiple
of B lies in the run with its next copy q words later, as the run is four periods long. So at each scale B the blocks of
a document are the keys of an automaton over whole-number sequences, the document's words run through it, and each
occurrence of a block at a distance d with B <= d < 2B after the block seeds an exact extension in both directions, as
far as words d apart are equal.

What no run can be in is not searched, all by proof and in whole arrays: in a run of period q < 2B each sequence of up to
four words that starts after the first period has a copy less than 2B words before, so only stretches of enough such
places in a row, widened by what a run may have around them, reach the automaton. Seeds inside a known run of a smaller
period give that same run again, as do further seeds of one distance in one extension; they are skipped. A stretch with
periods p < d, d not the smallest, is found at p's scale first and known by its ends.

Words are [^\x20\x09-\x0D]+. Null and empty texts have no words and no runs. Texts are searched whole, however long; a
document is the unit of work. Repeated rows are rows of their own, ties between runs are ordered by start, then period. A
null id stays null. Only id and text are read, extra columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.functions.regexlib import let
from reqloom.llm.bpe import slices
from reqloom.llm.common import WORD, table

LEAST, TIMES = 6, 4  # words of a run, at least, and periods
FAR = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def back_distances(keys: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the distance back to the last one with the same key (FAR: none, or not valid), and a dense name of its key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    back, names = np.full(len(keys), FAR), np.zeros(len(keys), dtype=np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    names[order[1:]] = np.cumsum(~same)
    back[~valid] = FAR
    return back, names


def grams(words: np.ndarray, starts: np.ndarray) -> dict[int, np.ndarray]:
    """Distances back of sequences of 1, 2 and 4 words within each document; starts: where documents begin, and the end."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(words))  # words from here to the document's end
    back, names = back_distances(doc * (int(words.max(initial=0)) + 1) + words, np.ones(len(words), dtype=bool))
    out = {1: back}
    for g in (1, 2):
        following = np.concatenate([names[g:], np.zeros(min(g, len(names)), dtype=np.int64)])
        out[2 * g], names = back_distances(names * (int(names.max(initial=0)) + 1) + following, left >= 2 * g)
    return out


def stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of at least so many true places in a row."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def seeds(words: np.ndarray, lo: int, hi: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of each occurrence of an aligned block in words[lo:hi], distance from block to 2 * block - 1."""
    first = -(-lo // block) * block
    blocks = range(first, hi - block + 1, block)
    if len(blocks) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sequence = tuple(words[lo:hi].tolist())
    names, automaton, held = {}, ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), []
    for at in blocks:
        key = sequence[at - lo : at - lo + block]
        if key not in names:
            names[key] = len(names)
            automaton.add_word(key, names[key])
        held.append(names[key])
    automaton.make_automaton()
    found = np.array(list(automaton.iter(sequence)), dtype=np.int64).reshape(-1, 2)
    at = found[:, 0] + lo - block + 1
    source = (at - block) // block  # of the blocks that begin block to 2 * block - 1 words before, there is one
    inside = source >= first // block
    at, source, name = at[inside], source[inside], found[inside, 1]
    same = np.array(held)[source - first // block] == name
    return source[same] * block, at[same] - source[same] * block


def equal_ahead(words: np.ndarray, i: int, j: int, end: int) -> int:
    """How many words from i on equal those from j on, j > i, before end."""
    n, step = 0, 64
    while j + n < end:
        m = min(step, end - j - n)
        differ = words[i + n : i + n + m] != words[j + n : j + n + m]
        k = int(differ.argmax())
        if differ[k]:
            return n + k
        n, step = n + m, 4 * step
    return n


class Runs:
    """The runs of one document, scale by scale."""

    def __init__(self, words: np.ndarray):
        self.words, self.mirror = words, words[::-1]
        self.found: dict[tuple[int, int], int] = {}  # (start, end): period
        self.reach = np.zeros(len(words), dtype=np.int64)  # farthest end of a known run of a smaller scale that begins by here

    def next_scale(self) -> None:
        self.reach[:] = 0
        for start, end in self.found:
            self.reach[start] = max(self.reach[start], end)
        np.maximum.accumulate(self.reach, out=self.reach)

    def search(self, lo: int, hi: int, block: int) -> None:
        if self.reach[lo] >= hi:  # inside one run of a smaller period, where no other fits
            return
        at, distance = seeds(self.words, lo, hi, block)
        new = self.reach[at] < at + distance + block
        at, distance = at[new], distance[new]
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        k, n = 0, len(self.words)
        while k < len(at):
            i, d = int(at[k]), int(distance[k])
            right = i + block + equal_ahead(self.words, i + block, i + block + d, n)
            left = i - equal_ahead(self.mirror, n - i - d, n - i, n)
            if right - left + d >= max(LEAST, TIMES * d):
                self.found.setdefault((left, right + d), d)
            group = int(np.searchsorted(distance, d, side="right"))
            k = max(k + 1, k + int(np.searchsorted(at[k:group], right - block, side="right")))

    def sorted(self) -> list[tuple[int, int, int]]:
        return sorted((start, end - start, d) for (start, end), d in self.found.items())


def periodic_runs(words: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Of each document (start, length, period) of its runs. words: whole numbers of all documents in a row."""
    known: dict[int, Runs] = {}
    back, block = grams(words, starts), 1
    longest = int(np.diff(starts).max(initial=0))
    while TIMES * block <= longest and LEAST <= longest:
        g = min(block, 4)
        for held in known.values():
            held.next_scale()
        for lo, hi in stretches(back[g] < 2 * block, max((TIMES - 1) * block - g + 1, LEAST - 1 if block == 1 else 1)):
            doc = int(np.searchsorted(starts, lo, side="right")) - 1
            begin, end = int(starts[doc]), int(starts[doc + 1])
            if doc not in known:
                known[doc] = Runs(words[begin:end])
            known[doc].search(max(lo - 2 * block + 1, begin) - begin, min(hi + g - 1, end) - begin, block)
        block *= 2
    return [known[doc].sorted() if doc in known else [] for doc in range(len(starts) - 1)]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that some run contains after its first period, joined by a space."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return " ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist())


_WORD = re.compile(WORD)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n in slices(pc.binary_length(batch.column(1))):
            lists = [_WORD.findall(t or "") for t in batch.column(1).slice(first, n).to_pylist()]
            flat = [w for words in lists for w in words]
            codes = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            found = periodic_runs(np.fromiter(map(codes.__getitem__, flat), np.int64, len(flat)), starts)
            columns = np.array([r for runs in found for r in runs], dtype=np.int64).reshape(-1, 3).T
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["start", "length", "period"]))
            texts = pa.array([collapsed(words, runs) for words, runs in zip(lists, found)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(starts)), runs, texts], names=["doc_id", "n_words", "runs", "collapsed"])


def word_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the runs of each document by start, then period, and its text without the repetitions."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_search, SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null without runs."""
    better = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs, where in each tenth document, by a checksum of its id, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i, v: F.when(i < v["a"], i).otherwise(v["a"] + F.pmod(i - v["a"], v["p"])).cast("int")
        text = lambda v: F.array_join(F.transform(words, lambda _, i: F.get(words, place(i, v))), " ")
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), text))

    planted = let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), repeated)
    return docs.withColumn("text", F.when(h % 10 == 0, planted).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", strongest(F.col("runs")))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
