"""What a document profile needs and does: samples, tables of contents, sections skipped, texts of section ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.functions.regexlib import java
from reqloom.functions.sections import sort_key
from reqloom.functions.text import strip

MIDDLE, END = "\n\n[... MIDDLE OF DOCUMENT ...]\n\n", "\n\n[... END OF DOCUMENT ...]\n\n"
BREAK = "\n\n"
SKIPPED = "\n[SECTION SKIPPED BY PROFILE]\n"
# Forms of a table of contents.
CONTENTS = (
    r"(?mi)(?:^|\n)(TABLE\s+OF\s+CONTENTS|CONTENTS|INDEX)[\s\S]*?(?=\n(?:1\.|Section|SECTION|Chapter|\d+\s+[A-Z])|$)",
    r"(?mi)(?:^|\n)(Table\s+of\s+Contents)[\s\S]*?(?=\n\n\n|\n(?:1\.|Section|SECTION))",
)


def _last_break(text: Column) -> Column:
    """Characters before the last paragraph break; -1 without one."""
    back = F.locate(BREAK, F.reverse(text))
    return F.when(back > 0, F.length(text) - back - 1).otherwise(-1)


def _from(text: Column, start: Column, size: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(F.lit(0), size))


def sample(text: Column, most: int = 18_000) -> Column:
    """A long text by its beginning (40 of 100), a part from three tenths on (35) and its end (25), cut at paragraphs."""
    head, body, tail = int(most * 0.4), int(most * 0.35), int(most * 0.25)
    begin = F.substring(text, 1, head)
    cut = _last_break(begin)
    begin = F.when(cut > head * 0.7, _from(begin, F.lit(0), cut)).otherwise(begin)
    start = F.floor(F.length(text) * 0.3).cast("int")
    middle = _from(text, start, F.lit(body))
    first, last = F.locate(BREAK, middle) - 1, _last_break(middle)
    middle = F.when((first > 0) & (last > first), _from(middle, first, last - first)).otherwise(middle)
    end = _from(text, F.greatest(F.length(text) - tail, start + body), F.length(text))
    first = F.locate(BREAK, end) - 1
    end = F.when((first > 0) & (first < 500), _from(end, first, F.length(end))).otherwise(end)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(begin, F.lit(MIDDLE), middle, F.lit(END), end))


def contents(text: Column) -> Column:
    """The table of contents, of 100 to 5000 characters; empty without one."""
    found = [F.regexp_extract(text, java(p), 0) for p in CONTENTS]
    return F.coalesce(*[F.when((F.length(f) > 100) & (F.length(f) < 5000), strip(f)) for f in found], F.lit(""))


def without_section(text: Column, title: Column) -> Column:
    """The section of this title replaced by a note: as an appendix, else under a bare heading, else under a numbered one."""
    said = F.regexp_replace(title, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    forms = (
        (r"(?i)(?:^|\n)(?:Appendix|Exhibit|Attachment)\s*[A-Z0-9]*[:\-\s]*", r"[\s\S]*?(?=\n(?:Appendix|Exhibit|Section|\d+\.|[A-Z]\.)|\z)"),
        (r"(?i)(?:^|\n)", r"[\s\S]*?(?=\n(?:Section|\d+\.\d|[A-Z]\.\d)|\z)"),
        (r"(?i)(?:^|\n)\d+(?:\.\d+)*\.?\s*", r"[\s\S]*?(?=\n\d+\.|\z)"),
    )
    out = None
    for before, after in forms:
        pattern = F.concat(F.lit(before), said, F.lit(after))
        hit = F.rlike(text, pattern)
        done = F.regexp_replace(text, pattern, F.lit(SKIPPED))
        out = F.when(hit, done) if out is None else out.when(hit, done)
    return out.otherwise(text)


def prompt(text: Column, most: int = 18_000) -> Column:
    """What a model is shown of a text: its sample, and its table of contents where it has one."""
    listed = contents(text)
    return F.concat(sample(text, most), F.when(listed != "", F.concat(F.lit("\n\n--- TABLE OF CONTENTS ---\n"), listed)).otherwise(""))


def guided(docs: DataFrame, profiles: DataFrame, id_: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """docs as a scan by profile takes them: skipped sections replaced by notes, families and prefixes to look for.

    Where the profile is missing or below least in confidence, the text stays whole and both are null: a scan without profile.
    """
    held = profiles.where(F.col("primary").isNotNull() & (F.coalesce("confidence", F.lit(0)) >= least)).select(id_, "families", "prefixes", F.col("skipped.title").alias("__titles"))
    rest = F.aggregate(F.coalesce("__titles", F.array().cast("array<string>")), F.col(text), without_section)
    return docs.drop("families", "prefixes").join(held, id_, "left").withColumn(text, rest).drop("__titles")


def range_texts(docs: DataFrame, rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Text of each range (doc_id, first, last: section labels): from 200 characters before its first row to 500 after its last."""
    keyed = rows.select("doc_id", sort_key(F.col("label")).alias("key"), "start", "end")
    wanted = ranges.select("doc_id", "first", "last", sort_key(F.col("first")).alias("low"), sort_key(F.col("last")).alias("high"))
    held = wanted.join(keyed, "doc_id").where(F.col("key").between(F.col("low"), F.col("high")))
    spans = held.groupBy("doc_id", "first", "last").agg(F.greatest(F.lit(0), F.min("start") - 200).alias("start"), (F.max("end") + 500).alias("end"))
    return spans.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "first", "last", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def prefix_sections(text: Column, prefixes: list[str]) -> Column:
    """The parts of a text under section numbers with one of the prefixes, a blank line between; the whole text without prefixes or hits."""
    if not prefixes:
        return text
    either = "|".join(map(re.escape, prefixes))
    parts = F.regexp_extract_all(text, F.lit(rf"(?md)(?:^|\n)({either}\d*(?:\.\d+)*[\s\S]*?)(?=\n(?!{either})\d+\.|$)"), F.lit(0))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(text)


def section_summary(sections: DataFrame) -> DataFrame:
    """doc_id, summary: the list of major sections, which stands for a summary where no model wrote one. sections: doc_id, major, title, at."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat_ws(": ", "major", "title").alias("line")))), lambda x: x["line"])
    return sections.groupBy("doc_id").agg(F.concat(F.lit("RFP SECTIONS:\n"), F.array_join(lines, "\n")).alias("summary"))
