"""Line dedup by sharded minimal perfect hashing.

Documents are dealt into buckets by their id. A bucket sends each shard one packet: the distinct 128-bit hashes of its
lines' keys that fall to that shard, with the smallest and largest document holding each and the number of holders. A very
common line is thus one entry a bucket, however many documents hold it. A shard merges its packets, builds a minimal
perfect hash over all its distinct hashes (levels of bit arrays; a hash that is alone at its place of a level is placed
there, the others go on to the next level), and stores at each hash's number a fingerprint, the count of documents that
hold it, and the smallest of them. The buckets' packets then probe these arrays: a hash without a place, whose fingerprint
differs, or whose count is one is no repeated line. The answers go back to the buckets, which cut their documents. Lines
themselves are never joined, and no text leaves its bucket.

Null and empty texts have one empty line. Lines with keys under MIN_CHARS code points always stay. Rows with the same
doc_id are one document. Rows with a null doc_id are one document too, behind all others; as they count as id 2**63 - 1,
a row of that id is of the same document. They are dealt by text, so they need not fit in one bucket. Repeats of a key within
its smallest document stay. Texts are cut whole, however long. An empty table gives an empty result. Extra columns travel
along unchanged; those named n_lines or n_dropped give way to the new ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqloom.llm.common import WHITE, table

MIN_CHARS = 10
SHARD_BYTES = 32 << 20  # text behind one shard, on average, in tables up to SHARD_BYTES * MANY; from there shards grow with the root of the table
MANY = 1 << 12
BUCKET_BYTES = 8 << 20  # text in one bucket, on average
LEAST = 64  # buckets and shards
NO_ID = np.iinfo(np.int64).max
ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("least", "<i8"), ("n", "<i8")])
ANSWER = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("owner", "<i8")])
GAMMA = 2.0


def line_hashes(text: str | None) -> tuple[list[str], list[bytes | None]]:
    """Lines, and each line's 16-byte hash; None for a key too short to matter."""
    lines = (text or "").split("\n")
    keys = [x.strip(WHITE) for x in lines]
    return lines, [xxhash.xxh3_128_digest(k.encode().lower()) if len(k) >= MIN_CHARS else None for k in keys]


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h2 + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ h1 ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers n distinct hashes from 0 to n - 1. Others get some number or -1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words  # bits a level (multiples of 64), all levels' bits
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(h1):
            size = 64 * math.ceil(max(1.0, GAMMA * len(h1)) / 64)
            at = (_mixed(h1, h2, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(np.asarray(sizes, dtype="<i8"), np.concatenate([np.zeros(0, "<u8"), *words]))

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, open_, base = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = base + (_mixed(h1[open_], h2[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[found]] = (self.before[at >> 6] + np.bitwise_count(below))[found]
            open_ = open_[~found]
            base += int(size)
        return out


def _merged(entries: np.ndarray) -> np.ndarray:
    """One entry for each hash."""
    if not len(entries):
        return entries
    e = entries[np.lexsort((entries["h2"], entries["h1"]))]
    start = np.flatnonzero(np.concatenate(([True], (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1]))))
    out = e[start].copy()
    out["least"], out["n"] = np.minimum.reduceat(e["least"], start), np.add.reduceat(e["n"], start)
    return out


def _packets(docs: pa.Table, shards: int) -> pa.Table:
    digests, ids = [], []
    for doc_id, text in zip(docs.column("__id").to_pylist(), docs.column("__text").to_pylist(), strict=True):
        found = set(line_hashes(text)[1]) - {None}
        digests += found
        ids += [NO_ID if doc_id is None else doc_id] * len(found)
    entries = np.zeros(len(ids), dtype=ENTRY)
    raw = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    entries["h1"], entries["h2"], entries["least"], entries["n"] = raw[:, 0], raw[:, 1], ids, 1
    entries = _merged(np.unique(entries))  # unique: rows of one document count once
    shard = (entries["h1"] % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    entries, names = entries[order], np.unique(shard)
    edges = np.searchsorted(shard[order], [*names, shards])
    bucket = docs.column("__bucket")[0].as_py()
    packed = [entries[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"bucket": pa.array([bucket] * len(names), pa.int32()), "shard": pa.array(names, pa.int32()), "packed": pa.array(packed, pa.binary())})


def _index(packets: pa.Table) -> pa.Table:
    e = _merged(np.concatenate([np.frombuffer(p, dtype=ENTRY) for p in packets.column("packed").to_pylist()]))
    perfect = PerfectHash.build(e["h1"], e["h2"])
    at = perfect.number(e["h1"], e["h2"])
    e = e[np.argsort(at)]
    columns = {"sizes": perfect.sizes, "words": perfect.words, "fingerprints": e["h2"], "counts": e["n"], "owners": e["least"]}
    return pa.table({"shard": packets.column("shard").slice(0, 1)} | {c: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for c, x in columns.items()})


def _probe(index: pa.Table, packets: pa.Table) -> pa.Table:
    buckets, answers = [], []
    if index.num_rows:
        read = lambda c, t: np.frombuffer(index.column(c)[0].as_py(), dtype=t)
        perfect, prints, counts, owners = PerfectHash(read("sizes", "<i8"), read("words", "<u8")), read("fingerprints", "<u8"), read("counts", "<i8"), read("owners", "<i8")
        for bucket, packed in zip(packets.column("bucket").to_pylist(), packets.column("packed").to_pylist(), strict=True):
            e = np.frombuffer(packed, dtype=ENTRY)
            at = perfect.number(e["h1"], e["h2"])
            held = np.flatnonzero(at >= 0)
            held = held[(prints[at[held]] == e["h2"][held]) & (counts[at[held]] > 1)]
            if len(held):
                out = np.zeros(len(held), dtype=ANSWER)
                out["h1"], out["h2"], out["owner"] = e["h1"][held], e["h2"][held], owners[at[held]]
                buckets.append(bucket)
                answers.append(out.tobytes())
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "answer": pa.array(answers, pa.binary())})


def _cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
    owner: dict[bytes, int] = {}
    for packed in answers.column("answer").to_pylist():
        a = np.frombuffer(packed, dtype=ANSWER)
        raw = packed
        owner.update((raw[24 * i : 24 * i + 16], o) for i, o in enumerate(a["owner"].tolist()))
    kept, lines_of, dropped = [], [], []
    for doc_id, text in zip(docs.column("__id").to_pylist(), docs.column("__text").to_pylist(), strict=True):
        doc_id = NO_ID if doc_id is None else doc_id
        lines, digests = line_hashes(text)
        stay = [x for x, d in zip(lines, digests, strict=True) if d is None or owner.get(d, doc_id) == doc_id]
        kept.append("\n".join(stay))
        lines_of.append(len(lines))
        dropped.append(len(lines) - len(stay))
    names = docs.schema.names[:-3]
    return pa.Table.from_arrays([*docs.columns[:-3], pa.array(kept, pa.string()), pa.array(lines_of, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "__kept", "__lines", "__dropped"])


def dedup_lines(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """df with text cut, and n_lines (before) and n_dropped; columns of these names give way."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(LEAST, math.ceil(total / BUCKET_BYTES))
    shards = max(LEAST, min(math.ceil(total / SHARD_BYTES), math.ceil(math.sqrt(total / SHARD_BYTES * MANY))))
    carry = [c for c in df.columns if c not in (text, "n_lines", "n_dropped")]
    ident = F.col(id_).cast("long")
    dealt = df.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)], ident.alias("__id"), F.col(text).alias("__text"), F.pmod(F.xxhash64(F.coalesce(ident.cast("string"), text)), F.lit(buckets)).cast("int").alias("__bucket"))
    packets = dealt.groupBy("__bucket").applyInArrow(lambda docs: _packets(docs, shards), "bucket int, shard int, packed binary")
    index = packets.groupBy("shard").applyInArrow(_index, "shard int, sizes binary, words binary, fingerprints binary, counts binary, owners binary")
    answers = index.groupBy("shard").cogroup(packets.groupBy("shard")).applyInArrow(_probe, "bucket int, answer binary")
    schema = T.StructType([*dealt.schema.fields[:-3], T.StructField("__kept", T.StringType()), T.StructField("__lines", T.LongType()), T.StructField("__dropped", T.LongType())])
    cut = dealt.groupBy("__bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_cut, schema)
    back = {c: F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)} | {text: F.col("__kept").alias(text)}
    return cut.select(*[back[c] for c in df.columns if c in back], F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents
), k as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), r as (
  select key, min(doc_id) as owner from k where length(key) >= 10 group by key having count(distinct doc_id) > 1
)
select k.doc_id, count(*) as n_lines, count(*) filter (r.owner <> k.doc_id) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (r.owner is null or r.owner = k.doc_id), '')) as kept_sha256
from k left join r using (key) group by k.doc_id
"""
