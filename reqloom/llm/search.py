"""Exact top-k inner products of whole-number vectors, in descending order of length.

Vectors are sorted by descending length (norm) and packed into blocks. All are rotated by the singular vectors of the
table's Gram matrix, so that the first coordinates hold most of each product. For a query and a block the product over
the first coordinates plus the product of the residual lengths (Cauchy-Schwarz) bounds the true score; where not even
that reaches the query's k-th best so far, nothing is computed. As lengths descend, a block whose greatest length times
the query's length falls short ends the query's search in that group. Survivors get their exact score in whole numbers.

Query groups meet vector groups in a grid of tasks; both groups have a fixed number of rows, so a task's memory does not
grow with the table. First the longest blocks meet all queries, which gives each query a k-th best score to start from.
Any other block is then sent to a query group only if its greatest length can reach the score of one of the group's
queries; components travel in the fewest bytes that hold them all. Each task gives at most k rows a query, merged per query.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without id. Shorter vectors count
as padded with zeros, and empty ones as zeros; vectors may be of any length that fits a task in blocks. Repeated ids are
rows of their own, but a query never meets a row of its own id. Ties go to the smaller id. An empty table, or one without
queries, gives an empty result. Components may be of any finite size whose multiple is finite: where products can leave 64
bits, Python's whole numbers take over, and a score beyond 64 bits counts as the greatest or least number there. Extra
columns are dropped; quantized() replaces columns named v or norm2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.llm.common import table, written

BLOCK = 1024  # vectors in a block
GROUP = 16  # blocks in a group
LEAST, MOST = -(1 << 63), (1 << 63) - 1
SLACK = 1e-6  # of the lengths' product, for rounding in the rotated sums


def quantized(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """df's usable vectors with v: floor(scale * component), and norm2."""
    scaled = lambda x: x.cast("double") * scale
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < float("inf")))
    v = F.transform(vector, lambda x: F.rint(scaled(x)) - F.when(F.rint(scaled(x)) > scaled(x), 1.0).otherwise(0.0))
    return df.where(fine).withColumn("v", v).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def gram(df: DataFrame, dims: int, unit: float = 1.0) -> np.ndarray:
    """Sum of v v' over the table, in units: dims * dims numbers, whatever the number of rows."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = dense(batch["v"], dims) / unit
            total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(dims * dims), "value": total.ravel()})

    out = np.zeros(dims * dims)
    for cell, value in df.select("v").mapInPandas(partial, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect():
        out[cell] = value
    return out.reshape(dims, dims)


def dense(vectors, dims: int) -> np.ndarray:
    """Whole numbers as doubles, which hold what scaling gave exactly; shorter vectors padded with zeros."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _pack(batches: Iterator[pd.DataFrame], dims: int, size: int, kind: str, unit: float = 1.0) -> Iterator[pd.DataFrame]:
    """Blocks of rows in the order given: block (its number), top (greatest length), n, packed (ids in 64 bits, then components as kind)."""
    ids, vectors = np.zeros(0, dtype="<i8"), np.zeros((0, dims), dtype=kind)
    number = TaskContext.get().partitionId() << 32

    def block(i: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        top = float(np.linalg.norm(v.astype(np.float64) / unit, axis=1).max())
        return pd.DataFrame({"block": [number], "top": [top], "n": [len(i)], "packed": [i.tobytes() + v.tobytes()]})

    for batch in batches:
        ids = np.concatenate([ids, batch["id"].to_numpy("<i8")])
        vectors = np.concatenate([vectors, dense(batch["v"], dims).astype(kind)])
        while len(ids) >= size:
            yield block(ids[:size], vectors[:size])
            number += 1
            ids, vectors = ids[size:], vectors[size:]
    if len(ids):
        yield block(ids, vectors)


def _unpack(packed: bytes, n: int, dims: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(packed, dtype=kind, offset=8 * n).reshape(n, dims)
    return np.frombuffer(packed, dtype="<i8", count=n), np.array([[int(x) for x in row] for row in v.tolist()], dtype=object).reshape(n, dims) if kind == "<f8" else v.astype(np.int64)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; of Python's numbers, those beyond 64 bits as the greatest or least number there."""
    found = vectors @ query
    return np.array([min(max(s, LEAST), MOST) for s in found.tolist()], dtype=np.int64) if found.dtype == object else found


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~scores))[:k]  # ~ is -scores - 1, without overflow at the least number


def search_blocks(queries: list[tuple[np.ndarray, np.ndarray]], blocks: list[tuple[np.ndarray, np.ndarray]], rotation: np.ndarray, k: int, head: int, floors: list[np.ndarray] | None = None, unit: float = 1.0) -> tuple[list[list[tuple[np.ndarray, np.ndarray]]], int]:
    """Of each query in each query block (scores, ids): its k best in the blocks, which come by descending length, with at least the score that floors gives; and the number of exact products.

    Lengths are in units, floors and bounds in squares of units, so that sums stay within doubles.
    """
    square = unit * unit
    prepared = []
    for ids, vectors in blocks:
        turned = (vectors.astype(np.float64) / unit) @ rotation
        prepared.append((ids, vectors, turned[:, :head], np.linalg.norm(turned[:, head:], axis=1), np.linalg.norm(turned, axis=1).max(initial=0.0)))
    out, exact = [], 0
    for at, (query_ids, query_vectors) in enumerate(queries):
        turned = (query_vectors.astype(np.float64) / unit) @ rotation
        lengths, rest = np.linalg.norm(turned, axis=1), np.linalg.norm(turned[:, head:], axis=1)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
        floor = np.full(len(query_ids), -np.inf) if floors is None else np.array(floors[at], dtype=np.float64)
        for ids, vectors, first, residual, top in prepared:
            slack = SLACK * lengths * top + SLACK
            open_ = np.flatnonzero(lengths * top + slack >= floor)
            if not len(open_):
                break
            bound = turned[open_, :head] @ first.T + rest[open_, None] * residual[None, :] + slack[open_, None]
            for row, q in enumerate(open_):
                near = np.flatnonzero((bound[row] >= floor[q]) & (ids != query_ids[q]))
                if not len(near):
                    continue
                if len(near) > 8 * k and floor[q] == -np.inf:  # a first floor from the most promising, so that the rest need not be computed
                    lead = near[np.argpartition(-bound[row, near], k)[: 2 * k]]
                    sums = products(vectors[lead], query_vectors[q])
                    exact += len(lead)
                    floor[q] = np.sort(sums)[-k] / square
                    near = near[bound[row, near] >= floor[q]]
                scores, exact = products(vectors[near], query_vectors[q]), exact + len(near)
                scores, names = np.concatenate([best[q][0], scores]), np.concatenate([best[q][1], ids[near]])
                top_k = _best(scores, names, k)
                best[q] = scores[top_k], names[top_k]
                if len(top_k) == k:
                    floor[q] = max(floor[q], scores[top_k[-1]] / square)
        out.append(best)
    return out, exact


def search_group(queries: list[tuple[np.ndarray, np.ndarray]], blocks: list[tuple[np.ndarray, np.ndarray]], rotation: np.ndarray, k: int, head: int, floors: list[np.ndarray] | None = None, unit: float = 1.0) -> tuple[list[tuple[int, int, int]], int]:
    """What search_blocks finds as (query id, id, score); and the number of exact products."""
    found, exact = search_blocks(queries, blocks, rotation, k, head, floors, unit)
    pairs = ((q, best) for (ids, _), block in zip(queries, found, strict=True) for q, best in zip(ids, block, strict=True))
    return [(int(q), int(i), int(s)) for q, (scores, names) in pairs for s, i in zip(scores, names, strict=True)], exact


def least_length(query_vectors: np.ndarray, floors: np.ndarray, unit: float = 1.0) -> float:
    """The length below which no vector reaches the floor of any of the queries."""
    lengths = np.linalg.norm(query_vectors.astype(np.float64) / unit, axis=1)
    some = (floors > 0) & (lengths > 0)  # others are reached by vectors of any length
    return float(((floors[some] - SLACK) / (lengths[some] * (1 + SLACK))).min()) if some.all() else -1.0


def needed(blocks: DataFrame, reach: DataFrame, groups: int, query_groups: int) -> DataFrame:
    """g, h, block: where each block (block, top) is sent, by the least length that query group h asks for. reach: h, reach."""
    met = blocks.select("block", "top", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))).alias("h")).join(reach, "h").where("top >= reach")
    return met.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"), "h", "block")


def top_inner_products(vectors: DataFrame, is_query, k: int = 5, id_: str = "vec_id", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """vectors: from quantized(). is_query: condition on its rows. query_id, rank (from 1), the id, score."""
    spark = vectors.sparkSession
    vectors = written(vectors.select(F.col(id_).cast("long").alias("id"), "v", "norm2", is_query.alias("is_query")).where(F.col("id").isNotNull()), "vectors")
    total, dims, most = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    schema = f"query_id long, rank int, {id_} long, score long"
    if not total or not dims:
        return spark.createDataFrame([], schema) if not total else _all_zero(vectors, k, id_)
    unit = 2.0 ** max(0, int(np.frexp(most)[1]) - 32)  # 1, unless components are large
    rotation = np.linalg.svd(gram(vectors, dims, unit))[0]
    head = max(1, dims // 4)
    parts = max(1, -(-total // (block * group)))
    kind = "<f8" if most >= 1 << 31 or dims * int(most) ** 2 >= MOST else "<i2" if most < 1 << 15 else "<i4"

    def packed(rows: DataFrame, n: int) -> DataFrame:
        ordered = rows.repartitionByRange(n, F.desc("norm2"), "id").sortWithinPartitions(F.desc("norm2"), "id")
        return written(ordered.select("id", "v").mapInPandas(lambda b: _pack(b, dims, block, kind, unit), "block long, top double, n int, packed binary"), "blocks")

    blocks = packed(vectors, parts)
    queries = packed(vectors.where("is_query"), max(1, parts // 50))
    n_blocks, n_queries = blocks.count(), queries.count()
    groups, query_groups = max(1, -(-n_blocks // group)), max(1, -(-n_queries // group))
    unpack = lambda rows: [_unpack(p, n, dims, kind) for p, n in zip(rows["packed"], rows["n"], strict=True)]

    def lead(_key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        asked = unpack(theirs)
        found, _ = search_blocks(asked, unpack(mine.sort_values("top", ascending=False)), rotation, k, head, None, unit)
        floors = [np.array([float(scores[-1]) / unit / unit if len(scores) == k else -np.inf for scores, _ in best]) for best in found]
        repeated = [np.repeat(ids, [len(x) for _, x in best]) for (ids, _), best in zip(asked, found, strict=True)]
        join = lambda best, at: np.concatenate([x[at] for x in best])
        return theirs[["h", "n", "packed"]].assign(
            floors=floors, reach=[least_length(v, f, unit) for (_, v), f in zip(asked, floors, strict=True)],
            query_id=repeated, id=[join(best, 1) for best in found], score=[join(best, 0) for best in found],
        )

    longest = [r.block for r in blocks.select("block", "top").orderBy(F.desc("top"), "block").limit(group).collect()]
    first = blocks.where(F.col("block").isin(longest)).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
    queries = queries.withColumn("h", F.pmod(F.xxhash64("block"), F.lit(query_groups)).cast("int"))
    led_schema = "h int, n int, packed binary, floors array<double>, reach double, query_id array<long>, id array<long>, score array<long>"
    led = written(first.groupBy("h").cogroup(queries.groupBy("h")).applyInPandas(lead, led_schema), "led")
    others = blocks.where(~F.col("block").isin(longest))
    sent = written(needed(others, led.groupBy("h").agg(F.min("reach").alias("reach")), groups, query_groups), "sent")
    left = blocks.join(sent, "block").select("g", "h", "top", "n", "packed")
    met = sent.select(F.col("g").alias("g"), F.col("h").alias("h")).distinct()  # names of its own, as both sides of the cogroup come from sent
    right = led.join(met, "h").select("g", "h", "n", "packed", "floors")

    def meet(_key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        rows, _ = search_group(unpack(theirs), unpack(mine.sort_values("top", ascending=False)), rotation, k, head, list(theirs["floors"]), unit)
        return pd.DataFrame(rows, columns=["query_id", "id", "score"], dtype="int64")

    later = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(meet, "query_id long, id long, score long")
    found = led.select(F.inline(F.arrays_zip("query_id", "id", "score"))).unionByName(later)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_), "score")


def _all_zero(vectors: DataFrame, k: int, id_: str) -> DataFrame:
    """Where every vector is empty all scores are 0, and the smallest ids win: only the k + 1 smallest can."""
    least = vectors.select("id").orderBy("id").limit(k + 1)
    pairs = vectors.where("is_query").select(F.col("id").alias("query_id")).join(F.broadcast(least), F.col("query_id") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_), F.lit(0).cast("long").alias("score"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_inner_products(vectors, F.col("vec_id") % 50 == 0)


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
