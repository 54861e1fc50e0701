"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code point order, null last, take the weights in turn; the budget is shared by weight, a target
stops at a multiple of its source's size, and the excess is reshared by weight until no target is above its stop.

Fitting: a source's documents are counted by exact length. Whole copies of the source are taken while the target holds
them. What remains is split over the lengths in proportion to their counts (so the mix keeps the source's shape), then
filled by one more document of a length from the longest down, and the last gap is closed by bounded-knapsack dynamic
programming over the lengths' remaining counts, as near to it from below as sums of lengths come. If that leaves a gap,
one longer document is added and the programme takes back what is then too much, where that comes nearer. However the
budget was filled before, the last programme finds the largest sum within what is left, so a source's miss is smaller than
its shortest document of which one more could be taken. Last, of each length as
many documents are selected as were counted, by a seeded hash; a length that many documents share is dealt over salts,
whose counts say how many each gives, so no length has to fit in one task.

Null text has size 0; a source of nothing but such documents has target 0. Null sources form one source. Repeated rows
are documents of their own, and ties go by all of a row's columns. Whole texts are counted, however long. Extra columns
travel along; those named source_size, target or times give way to the new ones. An empty table gives an empty result.
One number a source reaches the driver, where targets are set in order of how soon they stop.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.llm.common import table, written

WEIGHTS = (5.0, 2.0, 1.0)
SALTS = 64
GAP = 1 << 14  # most words that the dynamic programme closes; a larger gap is first filled from the longest length down
PLAN = "__source string, __size long, __copies long, __more long, source_size long, target double"


def targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Shares of the budget by weight, none above most times its size. Sources stop in order of size by weight, so one pass over that order does."""
    out, left, weight = [0.0] * len(sizes), budget, math.fsum(w for w, s in zip(weights, sizes, strict=True) if s > 0)
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: sizes[i] / weights[i])
    for k, i in enumerate(order):
        if left / weight * weights[i] <= most * sizes[i]:
            for j in order[k:]:
                out[j] = left / weight * weights[j]
            break
        out[i] = most * sizes[i]
        left -= out[i]
        weight -= weights[i]
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, gap: int) -> np.ndarray:
    """How many of each length, within counts, give the largest sum up to gap. Reached sums are kept as bits of one array."""
    took = np.zeros(len(lengths), dtype=np.int64)
    items = []  # (length index, how many): each count as powers of two, so that bits of 0/1 items make up any number
    for i in np.argsort(-lengths, kind="stable"):
        if 0 < lengths[i] <= gap:
            left, step = int(min(counts[i], gap // lengths[i])), 1
            while left > 0:
                items.append((int(i), min(step, left)))
                left -= step
                step *= 2
    first = np.full(gap + 1, -1, dtype=np.int64)  # the item that reached a sum first
    reached = np.zeros(gap + 1, dtype=bool)
    reached[0] = True
    for k, (i, n) in enumerate(items):
        step = int(lengths[i]) * n
        if step > gap:
            continue
        new = np.flatnonzero(reached[:-step] & ~reached[step:]) + step
        reached[new] = True
        first[new] = k
        if reached[gap]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:  # an item's predecessor was reached by earlier items only
        i, n = items[first[at]]
        took[i] += n
        at -= int(lengths[i]) * n
    return took


def fit(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """(copies of every document, documents of each length that get one more, or if negative one less), so that the words come near target."""
    total = int((lengths * counts).sum())
    goal = int(round(target))
    if total == 0 or goal <= 0:
        return 0, np.zeros(len(lengths), dtype=np.int64)
    copies, rest = divmod(goal, total)
    share = Fraction(rest, total)
    more = np.array([int(c) * share.numerator // share.denominator for c in counts], dtype=np.int64)
    rest -= int((more * lengths).sum())
    free = counts - more
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= GAP:
            break
        if lengths[i]:
            n = int(min(free[i], rest // lengths[i], 1))
            more[i] += n
            free[i] -= n
            rest -= n * int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):  # where one of each was not enough
        if rest <= GAP:
            break
        if lengths[i]:
            n = int(min(free[i], rest // lengths[i]))
            more[i] += n
            free[i] -= n
            rest -= n * int(lengths[i])
    closed = knapsack(lengths, free, min(rest, GAP))
    more += closed
    gap = rest - int((closed * lengths).sum())
    longer = np.flatnonzero((counts > more) & (lengths > gap))
    if gap > 0 and len(longer):  # one longer document too many, and others of that much less, if that comes nearer
        add = int(longer[np.argmin(lengths[longer])])
        swapped = more.copy()
        swapped[add] += 1
        held = swapped + (counts if copies else 0)
        held[add] = 0
        less = knapsack(lengths, np.minimum(held, counts + swapped), int(lengths[add]) - gap)
        if abs(int(lengths[add]) - gap - int((less * lengths).sum())) < gap:
            more = swapped - less
    return copies, more


def _fit_source(part: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = part["__size"].to_numpy(np.int64), part["__n"].to_numpy(np.int64)
    copies, more = fit(lengths, counts, float(part["target"].iloc[0]))
    return pd.DataFrame({"__source": part["__source"], "__size": lengths, "__copies": np.int64(copies), "__more": more, "source_size": part["source_size"], "target": part["target"]})


def mix(df: DataFrame, size: str, source: str = "source", weights: tuple = WEIGHTS, budget_share: float = 1.5, most: float = 2.0, seed: int = 77, identity: list[str] | None = None) -> DataFrame:
    """df with source_size, target (of its source) and times (how often the mix takes the row). identity: columns that tell rows apart."""
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("source_size", "target", "times")]
    identity = identity or names
    docs = df.select(
        *[F.col(c).alias(f"c_{i}") for i, c in enumerate(names)],
        F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("__source"),
        F.col(size).cast("long").alias("__size"),
        F.xxhash64(F.lit(seed), *identity).alias("__key"),
    ).withColumn("__salt", F.pmod(F.shiftright("__key", 20), F.lit(SALTS)).cast("int"))
    salted = docs.groupBy("__source", "__size", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    by_length = salted.groupBy("__source", "__size").agg(F.sum("__n").alias("__n"))
    found = by_length.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__n")).alias("total")).collect()  # one row a source
    order = sorted(found, key=lambda r: (r[0] == "n", r[0]))
    sizes = [int(r["total"]) for r in order]
    share = targets(sizes, [weights[i % len(weights)] for i in range(len(order))], budget_share * sum(sizes), most)
    goals = spark.createDataFrame([(r[0], t, g) for r, t, g in zip(order, sizes, share, strict=True)], "__source string, source_size long, target double")
    plan = by_length.join(goals, "__source").groupBy("__source").applyInPandas(_fit_source, PLAN)
    before = Window.partitionBy("__source", "__size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    quota = salted.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).join(plan, ["__source", "__size"])
    quota = quota.select("__source", "__size", "__salt", "__copies", "source_size", "target", F.least("__n", F.greatest(F.lit(0), F.abs("__more") - F.col("__before"))).alias("__quota"), F.signum("__more").cast("long").alias("__step"))
    ties = [F.col(f"c_{names.index(c)}") for c in identity] + [F.xxhash64(*[f"c_{i}" for i, c in enumerate(names) if "map<" not in df.schema[c].dataType.simpleString()])]
    place = F.row_number().over(Window.partitionBy("__source", "__size", "__salt").orderBy("__key", *ties))
    timed = docs.withColumn("__place", place).join(quota, ["__source", "__size", "__salt"])
    times = F.col("__copies") + F.when(F.col("__place") <= F.col("__quota"), F.col("__step")).otherwise(0)
    return timed.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(names)], "source_size", "target", times.alias("times"))


def words_of(text: str = "text"):
    """Number of words in a text; null: 0. Counted by splitting at white space, without building the words' list of matches."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", words_of().alias("size")), "mixing")
    out = mix(docs, "size", identity=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source")
