"""Product quantisation of vectors: Lloyd rounds that rescan only what may have changed.

Each vector is cut into equal consecutive parts; each part position has a codebook of its own. Vectors lie in chunks, one
row each. A chunk keeps for each entry of each codebook a heap of the parts assigned to it. A part's key is the slack
between its bounds, the distance to the second nearest entry minus that to its own, when it was last scanned, plus the
drift of its entry up to then. The drift of an entry grows each round by its own move and the greatest move of any other
entry. As long as a part's key exceeds its entry's drift, its entry is surely the nearest, so each round pops from each
heap only the parts whose key the drift has reached; these are measured exactly against all entries and pushed to the heap
of the nearest. Keys are rounded down, drifts up. Distances are whole numbers, so results are exact and reruns agree.

A round is one pass over the chunks, written to the shared folder, from where the sums of parts are added up by entry; only
the codebooks, whose size is fixed, go through the driver. The chunks of earlier rounds are removed.

Vectors that are null or hold null or non-finite components are dropped. Vectors count as padded with zeros to the length
of the longest, rounded up to a multiple of the number of parts; empty ones are zeros. With fewer vectors than entries,
codebooks have as many entries as there are vectors. Components may be of any finite size: where sums of squares leave 53
bits, Python's whole numbers take over; an error too large for 64 bits is null, as is a label's sum that holds one. Rows
without id come after all others where codebooks start, rows of equal ids in the order of their vectors; repeated rows are
rows of their own. Distances that tie go to the lower index. Extra columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.common import new_path, remove, table

CHUNK = 4096  # vectors in a row
EXACT = 1 << 53
LIMB = 31  # bits of a share of a sum
STATE = "ids array<long>, labels array<{label}>, kind string, x binary, keys binary, slots binary, sizes binary, sums array<string>"


def usable(vector: str):
    """Condition: the vector is there, and all its components are finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly; scale is a power of two."""
    y = x * scale
    return math.floor(y) if abs(y) < EXACT else int(x * scale) if math.isfinite(y) else int(x) * scale


def components(kind: str, raw: bytes, scale: int, rows: int) -> np.ndarray:
    """Whole-number components of a chunk: floats where these are exact, else Python's numbers."""
    if kind == "raw":
        return np.array([whole(v, scale) for v in np.frombuffer(raw, "<f8").tolist()], dtype=object).reshape(rows, -1)
    return np.frombuffer(raw, kind).astype(np.float64).reshape(rows, -1)


def stored(x: np.ndarray, scale: int) -> tuple[str, bytes]:
    """(kind, bytes) of real vectors: scaled whole numbers in the fewest bytes, or, where they are large, as they are."""
    most = np.abs(x).max(initial=0)
    if most >= 1 << 30:
        return "raw", x.astype("<f8").tobytes()
    v = np.floor(x * scale)
    most = np.abs(v).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, v.astype(kind).tobytes()


class Codebooks:
    """The entries of each part (parts, entries, size), as whole numbers, and how far each entry has drifted."""

    def __init__(self, entries: np.ndarray, drift: np.ndarray | None = None):
        self.entries = entries
        self.drift = np.zeros(entries.shape[:2]) if drift is None else drift
        self.most = max((abs(int(c)) for c in entries.ravel()), default=0)

    def distances(self, part: int, rows: np.ndarray) -> np.ndarray:
        """Squared distances of rows' parts to the part's entries, exactly: floats where these are exact, else Python's numbers."""
        entries = self.entries[part]
        most = max(self.most, max(map(abs, rows.ravel().tolist()), default=0)) if rows.dtype == object else max(self.most, float(np.abs(rows).max(initial=0)))
        if entries.shape[1] * 4 * most * most < EXACT:
            near = rows.astype(np.float64)[:, None, :] - entries.astype(np.float64)[None, :, :]
            return np.einsum("nkd,nkd->nk", near, near)
        exact = rows if rows.dtype == object else np.array([[int(v) for v in r] for r in rows.tolist()], dtype=object).reshape(rows.shape)
        return ((exact[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)

    def moved(self, sums: list[int], counts: list[int]) -> Codebooks:
        """Entries at the floor of their parts' mean, unused ones where they were; drifts with the moves."""
        parts, n, size = self.entries.shape
        entries, drift = self.entries.copy(), self.drift.copy()
        for p in range(parts):
            moves = np.zeros(n)
            for e in range(n):
                if count := counts[p * n + e]:
                    at = (p * n + e) * size
                    entries[p, e] = [s // count for s in sums[at : at + size]]
                    moves[e] = root(sum((a - b) ** 2 for a, b in zip(entries[p, e].tolist(), self.entries[p, e].tolist())))
            for e in range(n):
                drift[p, e] += (moves[e] + max((moves[f] for f in range(n) if f != e), default=0.0)) * (1 + 1e-9)
        return Codebooks(entries, drift)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for c in self.entries.ravel()).encode()).hexdigest()


def root(x) -> float:
    """Square root of a whole number of any size, as a float; infinite where it is none."""
    if x < EXACT * EXACT:
        return math.sqrt(x)
    found = math.isqrt(x)
    return float(found) if found.bit_length() < 1024 else math.inf


def scanned(books: Codebooks, part: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest entry of the part (ties: the lower index), and its key: slack plus drift, rounded down."""
    far = books.distances(part, rows)
    if far.dtype == object:
        order = np.array([sorted(range(len(r)), key=lambda e, r=r: (r[e], e))[:2] for r in far.tolist()]).reshape(len(rows), -1)
        roots = np.array([[root(r[e]) for e in o] for r, o in zip(far.tolist(), order.tolist())]).reshape(order.shape)
    else:
        order = np.argsort(far, axis=1, kind="stable")[:, :2]
        roots = np.sqrt(np.take_along_axis(far, order, axis=1))
    nearest = order[:, 0]
    if order.shape[1] < 2:
        return nearest, np.full(len(rows), np.inf, dtype=np.float32)
    with np.errstate(invalid="ignore"):
        keys = (roots[:, 1] - roots[:, 0]) - 1e-9 * (roots[:, 1] + roots[:, 0]) + books.drift[part][nearest]
    keys[np.isnan(keys)] = -np.inf  # of infinite lengths; such parts are scanned each time
    with np.errstate(over="ignore"):
        return nearest, np.nextafter(keys.astype(np.float32), np.float32(-np.inf))


class Chunk:
    """The heaps of a chunk: of each part and entry (key, slot), the least key first."""

    def __init__(self, x: np.ndarray, parts: int, entries: int):
        self.x, self.size, self.rescanned = x, x.shape[1] // parts, 0
        self.heaps: list[list[list[tuple[float, int]]]] = [[[] for _ in range(entries)] for _ in range(parts)]

    def part(self, p: int) -> np.ndarray:
        return self.x[:, p * self.size : (p + 1) * self.size]

    def load(self, keys: bytes, slots: bytes, sizes: bytes) -> None:
        pairs = list(zip(np.frombuffer(keys, "<f4").tolist(), np.frombuffer(slots, "<u2").tolist()))
        at = 0
        for p, counts in enumerate(np.frombuffer(sizes, "<u2").reshape(len(self.heaps), -1).tolist()):
            for e, n in enumerate(counts):
                self.heaps[p][e] = pairs[at : at + n]
                at += n

    def saved(self) -> tuple[bytes, bytes, bytes]:
        flat = [pair for part in self.heaps for heap in part for pair in heap]
        return np.array([k for k, _ in flat], "<f4").tobytes(), np.array([s for _, s in flat], "<u2").tobytes(), np.array([len(h) for part in self.heaps for h in part], "<u2").tobytes()

    def scan_all(self, books: Codebooks) -> None:
        for p, heaps in enumerate(self.heaps):
            nearest, keys = scanned(books, p, self.part(p))
            order = np.argsort(keys, kind="stable")  # in ascending order, a list is a heap
            for e in range(len(heaps)):
                mine = order[nearest[order] == e]
                heaps[e] = list(zip(keys[mine].tolist(), mine.tolist()))
            self.rescanned += len(self.x)

    def settle(self, books: Codebooks) -> None:
        """Pops the parts whose key their entry's drift has reached, and measures these anew."""
        for p, heaps in enumerate(self.heaps):
            out = []
            for heap, drift in zip(heaps, books.drift[p].tolist()):
                while heap and heap[0][0] <= drift:
                    out.append(heapq.heappop(heap)[1])
            if out:
                nearest, keys = scanned(books, p, self.part(p)[out])
                for slot, e, key in zip(out, nearest.tolist(), keys.tolist()):
                    heapq.heappush(heaps[e], (key, slot))
                self.rescanned += len(out)

    def sums(self) -> list[str]:
        """Decimal sums of components by part, entry and position, then counts by part and entry."""
        out, counts = [], []
        for p, heaps in enumerate(self.heaps):
            part = self.part(p)
            for heap in heaps:
                total = part[[slot for _, slot in heap]].sum(axis=0) if heap else [0] * self.size
                out += [str(int(v)) for v in total]
                counts.append(str(len(heap)))
        return out + counts

    def codes(self, books: Codebooks) -> tuple[np.ndarray, list[int]]:
        """Entry of each part of each vector, and each vector's squared error."""
        codes, errors = np.zeros((len(self.x), len(self.heaps)), dtype=np.uint8), [0] * len(self.x)
        for p, heaps in enumerate(self.heaps):
            for e, heap in enumerate(heaps):
                codes[[slot for _, slot in heap], p] = e
            far = np.take_along_axis(books.distances(p, self.part(p)), codes[:, p : p + 1].astype(np.int64), axis=1)[:, 0]
            errors = [a + int(b) for a, b in zip(errors, far.tolist())]
        return codes, errors


def padded(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Real vectors as rows of dims components, zeros at the end."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out, values = np.zeros((len(sizes), dims)), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's chunks, in shares of LIMB bits, which add up in 64 bits for any number of tasks below 2^32."""
    totals: list[int] = []
    for batch in batches:
        for sums in batch.column(0).to_pylist():
            values = list(map(int, sums))
            totals = [a + b for a, b in zip(totals, values)] if totals else values
    rows = []
    for cell, value in enumerate(totals):
        sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
        while value:
            rows.append((cell, limb, sign * (value & ((1 << LIMB) - 1))))
            value, limb = value >> LIMB, limb + 1
    columns = list(zip(*rows)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["cell", "limb", "value"])


def cell_sums(state: DataFrame, cells: int) -> list[int]:
    """The sums of all chunks. The rows that come to the driver are bounded by the size of the codebooks."""
    out = [0] * cells
    for cell, limb, value in state.select("sums").mapInArrow(added_up, "cell int, limb int, value long").groupBy("cell", "limb").agg(F.sum("value")).collect():
        out[cell] += value << (LIMB * limb)
    return out


def quantize(vectors: DataFrame, vector: str = "embedding", id_: str = "vec_id", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """(the id, the label, code: array of entries by part, error of each usable vector; the final codebooks)."""
    spark = vectors.sparkSession
    kind_of_label = vectors.schema[label].dataType
    kept = vectors.where(usable(vector)).select(F.col(id_).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    out_schema = f"{id_} long, {label} {kind_of_label.simpleString()}, code array<int>, error long"
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], out_schema), Codebooks(np.zeros((parts, 0, 0), dtype=object))
    size = max(1, -(-longest // parts))
    dims = size * parts
    first = [r.v for r in kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    start = np.array([[whole(x, scale) for x in [*v, *[0.0] * (dims - len(v))]] for v in first], dtype=object)
    n = len(first)
    books = Codebooks(start.reshape(n, parts, size).transpose(1, 0, 2))
    state_schema = STATE.format(label=kind_of_label.simpleString())

    def row(ids: pa.Array, labels: pa.Array, kind: str, raw: bytes, chunk: Chunk) -> pa.RecordBatch:
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        blobs = [pa.array([b], pa.binary()) for b in (raw, *chunk.saved())]
        return pa.RecordBatch.from_arrays([one(ids), one(labels), pa.array([kind]), *blobs, pa.array([chunk.sums()], pa.list_(pa.string()))], names=["ids", "labels", "kind", "x", "keys", "slots", "sizes", "sums"])

    def begin(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                kind, raw = stored(padded(some.column(2), dims), scale)
                chunk = Chunk(components(kind, raw, scale, some.num_rows), parts, n)
                chunk.scan_all(books)
                yield row(pa.concat_arrays([some.column(0)]), pa.concat_arrays([some.column(1)]), kind, raw, chunk)

    def loaded(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                kind, raw, *heaps = (batch.column(c)[i].as_py() for c in range(2, 7))
                chunk = Chunk(components(kind, raw, scale, len(ids)), parts, n)
                chunk.load(*heaps)
                chunk.settle(books)
                yield ids, labels, kind, raw, chunk

    def go_on(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
        for found in loaded(batches, books):
            yield row(*found)

    def finish(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
        for ids, labels, _, _, chunk in loaded(batches, books):
            codes, errors = chunk.codes(books)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * parts), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids, labels, lists, pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())], names=[id_, label, "code", "error"])

    def kept_as(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "chunks")
        df.write.parquet(path)
        return spark.read.schema(state_schema).parquet(path), path

    state, path = kept_as(kept.mapInArrow(lambda b: begin(b, books), state_schema))
    for done in range(rounds):
        totals = cell_sums(state, parts * n * (size + 1))
        books = books.moved(totals, totals[parts * n * size :])
        if done + 1 < rounds:
            now = books
            state, after = kept_as(state.mapInArrow(lambda b, now=now: go_on(b, now), state_schema))
            remove(spark, path)
            path = after
    return state.mapInArrow(lambda b: finish(b, books), out_schema), books


def with_label_errors(coded: DataFrame, label: str = "label", share: int = 1000) -> DataFrame:
    """coded with label_error, the sum of error over rows of equal label, nulls together (null if one is null or the sum leaves 64 bits).

    Labels that hold more than one in share of the rows are fewer than share, and are looked up in a broadcast table; the
    others meet in a join whose largest key is so bounded.
    """
    total = F.when(F.count(F.lit(1)) == F.count("error"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long")
    sums = coded.groupBy(label).agg(F.count(F.lit(1)).alias("n"), total.alias("label_error"))
    rows = coded.count()
    frequent = sums.where(F.col("n") * share > rows).select(F.col(label).alias("__label"), "label_error")
    rare = sums.where(F.col("n") * share <= rows).select(F.col(label).alias("__label"), "label_error")
    on = F.col(label).eqNullSafe(F.col("__label"))
    columns = [*coded.columns, "label_error"]
    return coded.join(F.broadcast(frequent), on).select(*columns).unionByName(coded.join(rare, on).select(*columns))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantize(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    path = new_path(spark, "codes")
    coded.write.parquet(path)
    coded = spark.read.schema(coded.schema).parquet(path)
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return with_label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds written out one after the other, over rows of (vector, part, position)."""
    head = """with kept as (select vec_id, label, row_number() over (order by vec_id, embedding) as r, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select r, (i - 1) // (n // 8) as part, (i - 1) % (n // 8) as pos, v[i] as c from (select r, v, len(v) as n, unnest(range(1, len(v) + 1)) as i from kept)),
b0 as materialized (select part, r - 1 as entry, pos, c from x where r <= 16)"""
    near = """a{k} as materialized (select r, part, entry, d from (select *, row_number() over (partition by r, part order by d, entry) as place from (
  select x.r, x.part, b.entry, sum((x.c - b.c) * (x.c - b.c))::bigint as d from x join b{k} b on x.part = b.part and x.pos = b.pos group by all)) where place = 1)"""
    mean = """b{k} as materialized (select part, entry, pos, coalesce(m.c, b.c) as c from b{j} b left join (
  select a.part, a.entry, x.pos, floor(sum(x.c)::double / count(*))::bigint as c from a{j} a join x on x.r = a.r and x.part = a.part group by all) m using (part, entry, pos))"""
    rounds = [part for k in range(6) for part in (near.format(k=k), mean.format(k=k + 1, j=k))]
    tail = """coded as (select r, string_agg(lpad(to_hex(entry), 2, '0'), '' order by part) as code, sum(d)::bigint as error from a6 group by r),
books as (select sha256(string_agg(c::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from b6)
select vec_id, lower(code) as code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept using (r) cross join books"""
    return ",\n".join([head, *rounds, near.format(k=6), tail])


OP13_SQL = _oracle()
