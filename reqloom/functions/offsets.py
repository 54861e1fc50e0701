"""Places in a text in UTF-16 units, as browsers and editors count, and in code points, as Spark does.

They differ by one for each letter outside the first plane that comes before. A text's such letters are found once, as an
array of places, mostly empty, which all its spans share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTSIDE = r"[\x{10000}-\x{10FFFF}]"


def wide_places(text: Column) -> Column:
    """Code point places of the letters that take two units, ascending; null text has none."""
    placed = F.transform(F.split(text, ""), lambda c, i: F.when(c >= "\U00010000", i))
    found = F.when(text.rlike(OUTSIDE), F.filter(placed, lambda i: i.isNotNull()))
    return F.coalesce(found, F.array().cast("array<int>"))


def _below(wide: Column, at: Column, value) -> Column:
    """How many places have a value(place, number) under at, by halving; values ascend."""
    whole = F.struct(F.lit(0).alias("low"), F.size(wide).alias("high"))

    def halved(a, _):
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        left = a["low"] < a["high"]
        under = left & (value(F.get(wide, middle), middle) < at)
        return F.struct(F.when(under, middle + 1).otherwise(a["low"]).alias("low"), F.when(left & ~under, middle).otherwise(a["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(wide) + F.lit(1))).cast("int") + 1)
    return F.when(F.size(wide) == 0, 0).otherwise(F.aggregate(steps, whole, halved)["low"])


def to_units(at: Column, wide: Column) -> Column:
    """The UTF-16 unit at which the code point begins."""
    return at + _below(wide, at, lambda w, i: w)


def to_points(unit: Column, wide: Column) -> Column:
    """The code point at a UTF-16 unit; for the second half of a letter, that letter."""
    return unit - _below(wide, unit, lambda w, i: w + i)


def spans_in_units(spans: DataFrame, docs: DataFrame, key: str, text: str, *places: str) -> DataFrame:
    """spans with places (code points of the text of the same key) in UTF-16 units, under the same names. Only texts with wide letters are joined."""
    wide = docs.where(F.col(text).rlike(OUTSIDE)).select(key, wide_places(F.col(text)).alias("__wide"))
    joined = spans.join(wide, key, "left")
    for place in places:
        joined = joined.withColumn(place, F.when(F.col("__wide").isNotNull(), to_units(F.col(place), F.col("__wide"))).otherwise(F.col(place)))
    return joined.drop("__wide").select(*spans.columns)
