"""Near-duplicate detection by one-permutation MinHash with optimal densification.

1. Each document's distinct word shingles are hashed once. The hash space is cut into BANDS * ROWS bins; a bin's value is
   the smallest hash in it. An empty bin takes the value of another, found by its own fixed sequence of random probes
   (optimal densification), so values stay independent between bins. Each band of ROWS bins is hashed to a bucket key.
2. Documents with equal shingle sets collapse to one node, named by its smallest id (128-bit set hash).
3. Candidates are stars, not pairs: the members of a bucket are tied to its centre, the member that shares most with others
   over all its buckets (in a group of copies, the text they were made from). A bucket of n gives at most n - 1 edges.
4. Edges are confirmed on the full shingle sets, and components of confirmed links are found by star contraction.
5. Where a bucket still holds several components, each member becomes a centre in its turn, and is tied to the members of
   other components. Turns come by random level: the fewest members have the highest, BASE times as many the next, and
   components are joined between levels. So a group of m copies is joined by its first centre or centres and costs about
   BASE * m edges, not m * m; and at the end every two members of a bucket in different components have met.
6. Before texts are fetched, two sketches are compared where the members meet. The parity sketch has one bit for each of
   PARITY places, the parity of the set's shingles there: two sketches differ in no more bits than the sets have shingles
   apart. The other holds the lowest bits of all bins, for sets too large for the first. Pairs that differ more than pairs
   of the sought similarity ever do give no edge; one that should is lost with probability under 1e-8.

A link of similarity s shares no band with probability (1 - s**ROWS)**BANDS: 1e-7 at 0.85 with 50 bands of 8.

Texts without words have an empty set and are linked with nothing. Rows that share an id are one document. Rows without
id take part in nothing: component null, kept true. Repeated rows get equal results. Whole texts count, however long. Of
docs only id and text are read, so other columns may have any names. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.common import table, written

WIDTH = 5
BANDS, ROWS = 50, 8
BINS = BANDS * ROWS
PLANES = 3  # lowest bits of a bin that the sketch holds
LONGS = -(-BINS // 64)  # of 64 bits in a plane
PARITY = 1024  # bits of the parity sketch
BASE = 16  # members of one level for each of the next
STAR = 64  # members that are confirmed against one copy of the centre's text
SALTS = 16
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, kept up to a number of words."""

    MOST = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHashes()


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; ASCII letters in lower case, words split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - width + 1)
    span = min(width, len(words))
    key = np.full(n, span, dtype=np.uint64)
    for i in range(span):
        key = key * _MULTIPLY + mixed(h[i : i + n] + np.uint64(i))
    return np.unique(mixed(key))


_PROBES: list[np.ndarray] = []


def _probe(step: int) -> np.ndarray:
    """Where each empty bin looks at its step-th try."""
    while len(_PROBES) <= step:
        _PROBES.append((mixed(np.arange(BINS, dtype=np.uint64) * _MULTIPLY + np.uint64(len(_PROBES) + 1)) % np.uint64(BINS)).astype(np.int64))
    return _PROBES[step]


EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values for each non-empty set."""
    out = np.full((len(sets), BINS), EMPTY, dtype=np.uint64)
    if not sets:
        return out
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out.reshape(-1), doc * BINS + place, mixed(h))
    full = out.copy()
    rows, bins = np.nonzero(out == EMPTY)
    step = 0
    while len(rows):
        taken = out[rows, _probe(step)[bins]]
        full[rows, bins] = taken
        open_ = taken == EMPTY
        rows, bins = rows[open_], bins[open_]
        step += 1
    return full


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS keys a row; equal keys of one band mean equal values in all its bins."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for i in range(ROWS):
        key = mixed(key * _MULTIPLY + sig[:, i::ROWS])
    return key


def sketches(sig: np.ndarray) -> np.ndarray:
    """PLANES * LONGS numbers a row: the lowest bits of all bins, plane by plane."""
    out = np.zeros((len(sig), PLANES, LONGS * 64), dtype=np.uint8)
    for k in range(PLANES):
        out[:, k, :BINS] = (sig >> np.uint64(k)) & np.uint64(1)
    return np.packbits(out.reshape(len(sig), -1), axis=1, bitorder="little").view("<i8")


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """PARITY // 64 numbers a row: of each place the parity of the set's shingles there."""
    place = np.concatenate([np.zeros(0, np.int64), *[(s & np.uint64(PARITY - 1)).astype(np.int64) + i * PARITY for i, s in enumerate(sets)]])
    odd = (np.bincount(place, minlength=len(sets) * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), PARITY), axis=1, bitorder="little").view("<i8")


def alike(a: str, b: str, percent: int) -> Column:
    """Whether sketches allow that similarity. a, b: rows with n and sketch (first the bins' planes, then the parities)."""
    unlike = lambda at: F.col(f"{a}.sketch")[at].bitwiseXOR(F.col(f"{b}.sketch")[at])
    bins = reduce(add, [F.bit_count(reduce(Column.bitwiseOR, [unlike(k * LONGS + i) for k in range(PLANES)])) for i in range(LONGS)])
    bits = reduce(add, [F.bit_count(unlike(PLANES * LONGS + i)) for i in range(PARITY // 64)])
    apart = F.floor((F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent) / (100 + percent))  # shingles in one of the sets only, at most
    odd = (1 - F.exp(apart * (-2 / PARITY))) / 2
    usual = odd * PARITY + 7 * F.sqrt(odd * (1 - odd) * PARITY)  # above the mean by seven deviations
    return (bits <= apart) & (bits <= usual) & (bins <= most_differing(percent))


def most_differing(percent: int) -> int:
    """Most bins that differ at that similarity: nine binomial deviations off the mean (six as measured, as densified bins vary more)."""
    agree = percent / 100 + (1 - percent / 100) / 2**PLANES
    return math.ceil(BINS * (1 - agree) + 9 * math.sqrt(BINS * agree * (1 - agree)))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingle_set(x) for x in part.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), BANDS), dtype=np.int64)
            sig = signatures([sets[i] for i in full])
            bins = np.zeros((len(sets), PLANES * LONGS), dtype=np.int64)
            keys[full], bins[full] = bucket_keys(sig).view(np.int64), sketches(sig)
            sums = [(int(s.sum(dtype=np.uint64)), int(mixed(s + _MULTIPLY).sum(dtype=np.uint64))) for s in sets]
            signed = lambda k: pa.array(np.array([x[k] for x in sums], dtype=np.uint64).view(np.int64))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), signed(0), signed(1), lists(keys), lists(np.hstack([bins, parities(sets)]))],
                names=["doc_id", "n", "s1", "s2", "buckets", "sketch"],
            )


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the shingle set), s1 and s2 (its 128-bit hash), buckets, sketch."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_describe, "doc_id long, n long, s1 long, s2 long, buckets array<long>, sketch array<long>")


def _confirm(rows: pa.Table, percent: int) -> pa.Table:
    """Of one star: the members whose sets reach percent of the union with the centre's. Rows without member hold the centre's text."""
    members, texts = rows.column("member").to_pylist(), rows.column("text")
    centre = [shingle_set(texts[i].as_py()) for i, m in enumerate(members) if m is None]
    linked = set()
    for i, m in enumerate(members):
        if m is not None and m not in linked:
            own = shingle_set(texts[i].as_py())
            for c in centre:
                both = len(np.intersect1d(own, c, assume_unique=True))
                if both and 100 * both >= percent * (len(own) + len(c) - both):
                    linked.add(m)
                    break
    out = sorted(linked)
    return pa.table({"a": pa.array([rows.column("centre")[0].as_py()] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})


def confirm(edges: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """edges (centre, member) that hold on full sets, as (a, b). texts: doc_id, text. A star's members are dealt over parts of about STAR, each with the centre's text."""
    sizes = edges.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    star = edges.join(sizes, "centre").select("centre", "member", F.pmod(F.xxhash64("member"), "parts").cast("int").alias("part"))
    members = star.join(texts, F.col("member") == F.col("doc_id")).select("centre", "part", "member", "text")
    heads = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    centres = heads.join(texts, F.col("centre") == F.col("doc_id")).select("centre", "part", F.lit(None).cast("long").alias("member"), "text")
    return members.unionByName(centres).groupBy("centre", "part").applyInArrow(lambda rows: _confirm(rows, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of all nodes of links (a, b), by alternating large and small stars."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    state = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = found
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "stars")


def level_of(node: str, top: int) -> Column:
    """A level from 0 to top by hash: about one node in BASE ** k has level k or more."""
    chance = F.pmod(F.xxhash64(F.lit(11), node), F.lit(1 << 30)) / (1 << 30)
    return reduce(add, [(chance < BASE**-k).cast("int") for k in range(1, top + 1)], F.lit(0))


def level_pairs(held: DataFrame, level: int, percent: int) -> DataFrame:
    """(centre, member): pairs of a bucket in different components, the higher of whose levels is the given one, that sizes and sketches allow.

    held: bucket, node, n, level, component, main (its largest component), star (its centre, which has met all), sketch.
    One of a pair is outside the main component, so members inside it never meet each other.
    """
    other = F.col("a.component") != F.col("b.component")
    fits = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    met = lambda a, b, more: a.alias("a").join(b.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & other & fits & more & alike("a", "b", percent))
    rows = held.where((F.col("level") <= level) & (F.col("node") != F.col("star")))
    outside, inside, now = F.col("component") != F.col("main"), F.col("component") == F.col("main"), F.col("level") == level
    once = (F.col("b.component") == F.col("b.main")) | (F.col("b.level") < level) | (F.col("a.node") < F.col("b.node"))
    pairs = met(rows.where(outside & now), rows, once).select(F.col("a.node").alias("centre"), F.col("b.node").alias("member"))
    more = met(rows.where(inside & now), rows.where(outside & ~now), F.lit(True)).select(F.col("a.node").alias("centre"), F.col("b.node").alias("member"))
    return pairs.unionByName(more).distinct()


def joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """found (node, component) after more links (a, b): only the components that the links name are joined anew."""
    if found is None:
        return written(components(links), "components")
    named = links
    for end in ("a", "b"):
        names = found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        named = named.join(names, end, "left").withColumn(end, F.coalesce(f"of_{end}", end)).drop(f"of_{end}")
    anew = written(components(named).select(F.col("node").alias("component"), F.col("component").alias("least")), "components")
    kept = found.join(anew, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    alone = anew.select(F.col("component").alias("node"), F.col("least").alias("component")).join(found, "node", "left_anti")
    return written(kept.unionByName(alone), "components")


def _links(sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """node, component of all nodes that confirmed links join; None if no two sets share a bucket."""
    bands = sets.select("node", "n", F.explode("buckets").alias("bucket"))
    held = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = written(bands.join(held, "bucket"), "shared")
    weights = shared.groupBy("node").agg(F.sum("held").alias("weight"))
    members = written(shared.join(weights, "node").select("bucket", "node", "n", "held", "weight"), "members")
    texts = written(docs.join(weights.select("node"), F.col("doc_id") == F.col("node"), "left_semi"), "texts")
    foremost = members.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), F.col("n").alias("centre_n"))).alias("c"))
    centres = written(foremost.select("bucket", (-F.col("c.minus")).alias("centre"), F.col("c.centre_n").alias("centre_n")), "centres")
    fits = (100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")) & (F.col("node") != F.col("centre"))
    edges = written(members.join(centres, "bucket").where(fits).select("centre", F.col("node").alias("member")).distinct(), "edges")
    fresh = written(confirm(edges, texts, percent), "links")
    found = None if fresh.isEmpty() else joined(None, fresh)
    labelled = lambda of: of.withColumn("component", F.col("node")) if found is None else of.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # From here on only the buckets of several components, with sketches and levels. A bucket's main component is named once;
    # if it gets another name later, all members count as outside it, which costs comparisons but loses no pair.
    rows = written(labelled(members), "labelled")
    sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("inside"))
    mains = sizes.groupBy("bucket").agg(F.max(F.struct("inside", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1")
    mains = written(mains.join(centres.select("bucket", F.col("centre").alias("star")), "bucket").select("bucket", "main", "star"), "mains")
    open_ = written(rows.join(mains, "bucket").select("bucket", "node", "n", "held", "component", "main", "star"), "open")
    largest = open_.agg(F.max("held")).first()[0]
    if largest is None:
        return found
    top = math.ceil(math.log(largest, BASE))
    several = written(open_.join(sets.select("node", "sketch"), "node").withColumn("level", level_of("node", top)), "several")
    for level in range(top, -1, -1):
        pairs = written(level_pairs(several, level, percent), "pairs")
        if not pairs.isEmpty():
            fresh = written(confirm(pairs, texts, percent), "links")
            if not fresh.isEmpty():
                found = joined(found, fresh)
                if level:
                    several = written(labelled(several.where(F.col("level") < level).drop("component")), "several")
    return found


def near_duplicates(docs: DataFrame, percent: int = 85, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    docs = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = written(describe(docs), "described")
    linkable = described.where("n > 0 and doc_id is not null")
    sets = written(linkable.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.max("n").alias("n"), F.first("buckets").alias("buckets"), F.first("sketch").alias("sketch")), "sets")
    found = _links(sets.select("node", "n", "buckets", "sketch"), docs, percent)
    several = linkable.groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("doc_id")
    if not several.isEmpty():  # rows of one id with different texts join their sets
        names = written(linkable.join(several, "doc_id").join(sets.select("s1", "s2", "node"), ["s1", "s2"]).select("doc_id", "node").distinct(), "names")
        same = names.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        found = written(components(same if found is None else same.unionByName(found.select(F.col("component").alias("a"), F.col("node").alias("b")))), "components")
    labels = sets.select("s1", "s2", "node", "last")
    labels = labels.withColumn("component", F.lit(None).cast("long")) if found is None else labels.join(found, "node", "left")
    # Only sets of several documents or in a larger component need a label; each is there once a salt, for sets that very many documents share.
    labels = labels.where("component is not null or last <> node").select("s1", "s2", F.coalesce("component", "node").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = described.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.expr("n > 0 and doc_id is not null").alias("linkable"))
    out = rows.join(labels, ["s1", "s2", "salt"], "left")
    component = F.when(F.col("linkable"), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
