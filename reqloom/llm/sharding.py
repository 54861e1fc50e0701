"""Uniform shuffle of a table into shards of exact size by a hypergeometric communication matrix.

Rows are dealt into virtual partitions by a seeded hash of their content, so a partition holds the same rows in any run.
Only the partition sizes reach the driver. There the matrix of how many rows of each partition go to each shard is drawn
exactly (a multivariate hypergeometric draw per partition, without replacement over what the shards still lack).
Each partition permutes its rows by one seeded key and cuts them at the drawn counts; after the exchange each shard is
permuted again by a second key. The second permutation is block-wise (random block, then random key in the block), so
no shard has to fit in one task; a slot is the block's offset plus the rank in the block.

Nulls: a null key or payload hashes as such. Repeated rows are separate rows; which of two identical ones gets which slot
cannot be told apart in the result. Null and empty texts are as any other; texts themselves are never moved, however long.
An empty table gives no rows. Extra columns travel along; columns named shard or slot give way to the new ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.llm.common import table

PARTITION_ROWS = 50_000
LEAST_PARTITIONS = 64
LEAST_BLOCKS = 16


def _log_choose_terms(k: int, good: int, bad: int, draws: int) -> float:
    return math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(draws - k + 1) + math.lgamma(bad - draws + k + 1)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact hypergeometric draw; beyond the library's limit of 10**9 by rejection from a table-mountain hat."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    top = _log_choose_terms(mode, good, bad, draws)
    mean = draws * good / total
    spread = math.sqrt(max(1.0, mean * (bad / total) * (total - draws) / max(1, total - 1)))
    width = 1.7155277699214135 * math.sqrt(spread * spread + 0.5) + 0.8989161620588988  # ratio-of-uniforms hat: 2*sqrt(2/e), 3-2*sqrt(3/e)
    while True:
        u, v = rng.random(), rng.random()
        if u <= 0.0:
            continue
        x = mean + 0.5 + width * (v - 0.5) / u
        if not low <= x < high + 1:
            continue
        k = math.floor(x)
        if 2.0 * math.log(u) <= top - _log_choose_terms(k, good, bad, draws):
            return k


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """counts[p, s]: rows of partition p that go to shard s. Row sums are rows, column sums are columns."""
    assert sum(rows) == sum(columns)
    rng = np.random.Generator(np.random.PCG64(seed))
    left, out = list(columns), np.zeros((len(rows), len(columns)), dtype=np.int64)
    for p, n in enumerate(rows):
        rest, pool = n, sum(left)
        for s in range(len(left)):
            pool -= left[s]
            got = _hypergeometric(rng, left[s], pool, rest)
            out[p, s] = got
            left[s] -= got
            rest -= got
    return out


def shard_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def uniform_shards(df: DataFrame, identity: list[Column], shards: int = 8, seed: int = 20_241, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in each shard). identity: columns that tell the rows apart."""
    spark = df.sparkSession
    carried = [c for c in df.columns if c not in ("shard", "slot")]
    row = F.struct(*carried).alias("__row") if carried else F.struct(F.lit(1)).alias("__row")
    keyed = df.select(row, F.xxhash64(F.lit(seed), *identity).alias("__k1"), F.xxhash64(F.lit(seed + 1), *identity).alias("__k2"), F.struct(*identity).alias("__tie"))
    total = df.count()
    parts = max(LEAST_PARTITIONS, math.ceil(total / partition_rows))
    keyed = keyed.withColumn("__part", F.pmod(F.xxhash64("__k1"), F.lit(parts)).cast("int"))
    sizes = dict(keyed.groupBy("__part").count().collect())  # one number for each virtual partition
    order = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in order], shard_sizes(total, shards), seed)
    cuts = spark.createDataFrame([(p, [int(x) for x in np.cumsum(row)]) for p, row in zip(order, matrix, strict=True)], "__part int, __cuts array<bigint>")
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__k1", "__tie")) - 1
    dealt = keyed.withColumn("__place", place).join(cuts, "__part").withColumn("__shard", F.size(F.filter("__cuts", lambda c: c <= F.col("__place"))))
    blocks = max(LEAST_BLOCKS, math.ceil(total / shards / partition_rows))
    dealt = dealt.withColumn("__block", F.pmod(F.xxhash64("__k2"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("__shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__shard", "__block").agg(F.count(F.lit(1)).alias("__n")).withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("__shard", "__block").orderBy("__k2", "__tie")) - 1
    out = dealt.withColumn("__rank", rank).join(offsets, ["__shard", "__block"])
    return out.select(*[F.col("__row")[c].alias(c) for c in carried], F.col("__shard").cast("int").alias("shard"), (F.col("__offset") + F.col("__rank")).cast("long").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = uniform_shards(docs, [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
