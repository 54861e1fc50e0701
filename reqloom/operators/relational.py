"""Nested includes, semi- and anti-joins, similarity, intervals, pagination and history."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """parents with an array of their children's rows in order; empty where there are none."""
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in children.columns if c not in (key, order)]))).alias(name))
    joined = parents.join(rows, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


SMALL = 1000  # rows of a group that a single task compares


def _words(text: str | Column) -> Column:
    """Distinct words over two characters, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 2)))


def word_sets(rows: DataFrame, group: str, id_: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(g, id, set of each row with words over two characters; g, set, n, words of each distinct set): a set goes by its smallest id."""
    rows = rows.select(F.col(group).alias("g"), F.col(id_).alias("id"), _words(text).alias("words")).where(F.size("words") > 0)
    sets = rows.groupBy("g", "words").agg(F.min("id").alias("set"), F.size(F.first("words")).alias("n"))
    return rows.join(sets, ["g", "words"]).select("g", "id", "set"), sets


def alike_sets(sets: DataFrame, least: float) -> DataFrame:
    """g, s, t (s < t), similarity of the sets of a group above such a Jaccard similarity.

    Prefix filtering: with words ordered by rarity, two similar sets share a word among the first of each, so only sets that
    meet on such a word are compared, once each; the sizes bound the similarity before that, and words are fetched for those
    pairs only.
    """
    count = sets.select("g", "set", "n", F.explode("words").alias("word"))
    rarity = count.groupBy("g", "word").agg(F.count(F.lit(1)).alias("held"))
    place = F.row_number().over(Window.partitionBy("g", "set").orderBy("held", "word"))
    first = count.join(rarity, ["g", "word"]).withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    a, b = first.alias("a"), first.alias("b")
    near = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.set") < F.col("b.set")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least - 1e-9))
    met = near.select(F.col("a.g").alias("g"), F.col("a.set").alias("s"), F.col("b.set").alias("t")).distinct()
    words_of = lambda end: sets.select("g", F.col("set").alias(end), F.col("words").alias(f"words_{end}"))
    both = F.size(F.array_intersect("words_s", "words_t"))
    return met.join(words_of("s"), ["g", "s"]).join(words_of("t"), ["g", "t"]).select("g", "s", "t", (both / (F.size("words_s") + F.size("words_t") - both)).alias("similarity")).where(F.col("similarity") > least)


def alike_texts(rows: DataFrame, group: str, id_: str, text: str, least: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(group, a, b, similarity of alike sets by their smallest ids; group, the id, set of each row): no pairs of copies, however many there are."""
    named, sets = word_sets(rows, group, id_, text)
    pairs = alike_sets(sets, least).select(F.col("g").alias(group), F.col("s").alias("a"), F.col("t").alias("b"), "similarity")
    return pairs, named.select(F.col("g").alias(group), F.col("id").alias(id_), "set")


def by_size(rows: DataFrame, group: str, small: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups of so many rows at most, and those of larger groups; of these, one in small rows is a key at most, so keys are few. Rows without a group are in neither."""
    large = F.broadcast(rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > small).select(group))
    return rows.where(F.col(group).isNotNull()).join(large, group, "left_anti"), rows.join(large, group, "left_semi")


def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(g, ids, word sets) of each group of rows that come in order of it; the rows of one group are held."""
    group, ids, sets = None, [], []
    for batch in batches:
        for g, i, words in zip(*(batch.column(c).to_pylist() for c in ("g", "id", "words")), strict=True):
            if g != group:
                if ids:
                    yield group, ids, sets
                group, ids, sets = g, [], []
            ids.append(i)
            sets.append(frozenset(words))
    if ids:
        yield group, ids, sets


def alike(s: frozenset, t: frozenset, least: float) -> float:
    """Similarity of two sets, or 0 where it is not above least."""
    both = len(s & t) if min(len(s), len(t)) >= max(len(s), len(t)) * least - 1e-9 else 0
    found = both / (len(s) + len(t) - both)
    return found if found > least else 0.0


def compared(rows: DataFrame, group: str, id_: str, text: str, work: Callable[[list, list], Iterable[tuple]], names: tuple[str, ...], more: str = "") -> DataFrame:
    """g and what work makes of the ids and word sets of each group, in order of id: ids under each of names, and more. A group is held by one task."""
    given = rows.select(F.col(group).alias("g"), F.col(id_).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    fields = [("g", "g"), *((n, "id") for n in names)]
    schema = ", ".join(f"{n} {given.schema[c].dataType.simpleString()}" for n, c in fields) + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field(c).type for _, c in fields] + [pa.float64()] * bool(more)
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[*(n for n, _ in fields), *more.split()[1:2]])
        out = []
        for g, ids, sets in in_groups(chain((first,), batches)):
            for row in work(ids, sets):
                out.append((g, *row))
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = given.repartition(n, "g").sortWithinPartitions("g", "id")  # texts travel, not their words
    return dealt.select("g", "id", _words("text").alias("words")).where(F.size("words") > 0).mapInArrow(run, schema)


def jaccard_pairs(rows: DataFrame, group: str, id_: str, text: str, least: float = 0.9, small: int = SMALL) -> DataFrame:
    """Pairs (a < b) of rows of a group above such a similarity (equal texts below 1 included): all pairs, copies too. Where copies are many, take alike_texts.

    The rows of a small group are compared in one task; of larger groups, sets meet by joins on rare words.
    """

    def pairs(ids: list, sets: list) -> Iterator[tuple]:
        for k, (a, s) in enumerate(zip(ids, sets)):
            for b, t in zip(ids[k + 1 :], sets[k + 1 :]):
                if a < b and (found := alike(s, t, least)):
                    yield a, b, found

    few, many = by_size(rows, group, small)
    near = compared(few, group, id_, text, pairs, ("a", "b"), ", similarity double").withColumnRenamed("g", group)
    return near.unionByName(_joined_pairs(many, group, id_, text, least))


def _joined_pairs(rows: DataFrame, group: str, id_: str, text: str, least: float) -> DataFrame:
    named, sets = word_sets(rows, group, id_, text)
    member = lambda end, as_: named.select("g", F.col("set").alias(end), F.col("id").alias(as_))
    unlike = alike_sets(sets, least).join(member("s", "x"), ["g", "s"]).join(member("t", "y"), ["g", "t"]).select("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    equal = member("set", "a").join(member("set", "b"), ["g", "set"]).where("a < b").select("g", "a", "b", F.lit(1.0).alias("similarity"))
    return unlike.unionByName(equal if least < 1 else equal.where(F.lit(False))).withColumnRenamed("g", group)


def _fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs in order of the later set, the later sets that meet an earlier one which has not fallen itself; names of fallen sets of one group are held."""
    group, fallen = None, set()
    for batch in batches:
        new = []
        for g, s, t in zip(*(batch.column(c).to_pylist() for c in ("g", "s", "t")), strict=True):
            if g != group:
                group, fallen = g, set()
            falls = s not in fallen and t not in fallen
            if falls:
                fallen.add(t)
            new.append(falls)
        yield batch.select(["g", "t"]).filter(pa.array(new, pa.bool_()))


def keep_first_unlike(rows: DataFrame, group: str, id_: str, text: str, least: float = 0.9, small: int = SMALL) -> DataFrame:
    """Greedy near-dedup in order of id: a row goes if it is like one that was kept.

    Small groups are gone through by one task each. In larger ones copies share the fate of the first of them, or go because
    of it, so only sets are compared; pairs stream through in order.
    """
    if least >= 1:
        return rows

    def falls(ids: list, sets: list) -> Iterator[tuple]:
        kept = []
        for i, t in zip(ids, sets):
            if any(alike(s, t, least) for s in kept):
                yield (i,)
            else:
                kept.append(t)

    few, many = by_size(rows, group, small)
    gone = compared(few, group, id_, text, falls, ("id",)).unionByName(_joined_falls(many, group, id_, text, least)).withColumnsRenamed({"g": group, "id": id_})
    return rows.join(gone, [group, id_], "left_anti")


def _joined_falls(rows: DataFrame, group: str, id_: str, text: str, least: float) -> DataFrame:
    """g, id of the rows that go."""
    named, sets = word_sets(rows, group, id_, text)
    pairs = alike_sets(sets, least).select("g", "s", "t")
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in ("g", "t"))
    fallen = pairs.repartition("g").sortWithinPartitions("g", "t", "s").mapInArrow(_fall, schema).select("g", F.col("t").alias("id"))
    return named.where("id <> set").select("g", "id").unionByName(fallen)


def ancestors(section: Column) -> Column:
    """array: the id and all its dotted prefixes."""
    parts = F.split(section, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def uncovered_sections(stated: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """Stated sections with no extracted section equal to, above or below them. Both: key, section."""
    above = extracted.select(key, F.explode(ancestors(F.col("section"))).alias("section")).distinct()
    below = stated.select(key, "section", F.explode(ancestors(F.col("section"))).alias("prefix"))
    held = below.join(extracted.select(key, F.col("section").alias("prefix")).distinct(), [key, "prefix"], "left_semi").select(key, "section").distinct()
    return stated.select(key, "section").distinct().join(above, [key, "section"], "left_anti").join(held, [key, "section"], "left_anti")


BIN_ROWS = 100_000  # points and intervals in a stretch of positions, about


def outside_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str = "at", start: str = "start", end: str = "end", bin_rows: int = BIN_ROWS) -> DataFrame:
    """Points of a key in none of its intervals (both ends inside); at, start and end are whole numbers or times of one type.

    A sweep in place of a join: with points and starts in order, a point is inside exactly if the greatest end so far reaches
    it. Positions fall into bins of about bin_rows rows, each swept by itself from the greatest end of the bins before it,
    so a key with very many rows is spread over many tasks, and the cost is that of a sort.
    """
    whole = lambda c: F.unix_micros(c.cast("timestamp")) if points.schema[at].dataType.typeName().startswith("timestamp") else c.cast("long")
    kept = points.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    marks = kept.select(F.struct(*points.columns).alias("point"), F.col(key).alias("k"), whole(F.col(at)).alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("reach"))
    none = F.lit(None).cast(marks.schema["point"].dataType)
    spans = intervals.where(F.col(key).isNotNull() & (F.col(end) >= F.col(start))).select(none.alias("point"), F.col(key).alias("k"), whole(F.col(start)).alias("x"), F.lit(0).alias("kind"), whole(F.col(end)).alias("reach"))
    both = marks.unionByName(spans)
    low, high, n = both.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    width = max(1, -(-(high - low + 1) * bin_rows // n)) if n else 1
    binned = both.withColumn("bin", F.floor((F.col("x") - F.lit(low or 0)) / F.lit(width)))
    before = F.max("reach").over(Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    carried = binned.groupBy("k", "bin").agg(F.max("reach").alias("reach")).withColumn("carried", before).select("k", "bin", "carried")
    so_far = F.max("reach").over(Window.partitionBy("k", "bin").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0))
    swept = binned.withColumn("so_far", so_far).where("kind = 1").join(carried, ["k", "bin"])
    reach = F.greatest("so_far", "carried")
    outside = swept.where(reach.isNull() | (reach < F.col("x"))).select("point.*")
    return outside.unionByName(points.where(F.col(key).isNull() | F.col(at).isNull()))


def page(rows: DataFrame, order: list, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """LIMIT and OFFSET within bounds: 1 to 100 rows (20), from 0 to 10 000 (0)."""
    limit = 20 if limit is None else min(max(int(limit), 1), 100)
    offset = 0 if offset is None else min(max(int(offset), 0), 10_000)
    return rows.orderBy(*order).offset(offset).limit(limit)


def text_search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the needle, in any case, in one of the columns; signs of patterns are plain signs."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return rows.where(hit)


def clean_tags(tags: Column) -> Column:
    """Trimmed, in lower case, 1 to 50 characters; the first 20, then distinct."""
    ok = F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: F.length(t).between(1, 50))
    return F.array_distinct(F.slice(ok, 1, 20))


def has_any(tags: Column, wanted: list[str]) -> Column:
    """Whether the cleaned tags hold one of the wanted ones; wanted tags are cleaned alike. False for null."""
    return F.coalesce(F.arrays_overlap(tags, clean_tags(F.array(*[F.lit(w) for w in wanted]).cast("array<string>"))), F.lit(False))


def json_equals(json: Column, path: str, value: str) -> Column:
    """Whether the JSON value at a path is the given text; false where it is absent or null."""
    return F.coalesce(F.get_json_object(json, path) == value, F.lit(False))


def change_history(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Versions: the former value at each change, newest first (version 1). No version where there was no former value."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = events.withColumn("former", F.lag(value).over(w)).where(F.col("former").isNotNull() & ~F.col("former").eqNullSafe(F.col(value)))
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return changed.withColumn("version", F.row_number().over(newest))


def first_of_key(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def text_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
