"""Keys and sort keys of section labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = r"^(?i:(Section|Part|Chapter|Article)\s+(\d+|[A-Z]+))"


def _plain_category(s: Column) -> Column:
    """Key of a trimmed label without prefix word and comma."""
    roman = F.regexp_extract(s, r"^(?i:([IVX]+)(?:[^A-Z]|$))", 1)
    letter = s.rlike("^[A-Za-z]")
    return (
        F.when(s.rlike("^[0-9]"), F.regexp_extract(s, "^([0-9]+)", 1))
        .when(letter & ~s.rlike("^[A-Za-z][A-Za-z]"), F.upper(F.substring(s, 1, 1)))
        .when(letter & (roman != ""), F.upper(roman))
        .otherwise(s)
    )


def major_category(section: Column, prefix_and_comma: bool = True) -> Column:
    """Grouping key of a section label; blank or null: Uncategorized."""
    s = F.trim(section)
    named = F.concat_ws(" ", F.regexp_extract(s, PREFIX, 1), F.regexp_extract(s, PREFIX, 2))
    head = F.trim(F.substring_index(s, ",", 1))
    head_named = F.concat_ws(" ", F.regexp_extract(head, PREFIX, 1), F.regexp_extract(head, PREFIX, 2))
    head_key = F.when(head == "", "Uncategorized").when(head.rlike(PREFIX), head_named).otherwise(_plain_category(head))
    key = F.when(s.rlike(PREFIX), named).when(s.contains(","), head_key).otherwise(_plain_category(s)) if prefix_and_comma else _plain_category(s)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("Uncategorized")).otherwise(key)


def category_title(section: Column) -> Column:
    """Title that a label carries behind its key, or null."""
    s, key = F.trim(section), major_category(section)
    shapes = (
        (r"^(?i:([A-Z])[.:\-]\s*(.+)$)", 1, 2),
        (r"^(?i:([A-Z])\s+([A-Z][A-Za-z\s,&\-]+)$)", 1, 2),
        (r"^(\d+)[.\s:\-]+\s*([A-Za-z].+)$", 1, 2),
        (r"^(?i:((?:Section|Part|Chapter|Article)\s+(?:\d+|[A-Z]+))[.\s:\-]+\s*([A-Za-z].+)$)", 1, 2),
        (r"^(?i:([IVX]+)[.:\-]\s*(.+)$)", 1, 2),
    )
    found = [F.when(s.rlike(p) & (F.upper(F.regexp_extract(s, p, k)) == F.upper(key)), F.trim(F.regexp_extract(s, p, t))) for p, k, t in shapes]
    return F.when(s != "", F.coalesce(*found))


ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")


def section_parts(section: Column) -> Column:
    """array<int> that sorts labels by number, then letter, then roman numeral; ends in no zeros, as missing parts count as 0."""

    def part(p: Column) -> Column:
        number = F.regexp_extract(p, r"^\s*([0-9]{1,9})", 1)
        roman = F.array_position(F.array(*[F.lit(r) for r in ROMAN]), F.upper(p)).cast("int")
        return (
            F.when(number != "", number.try_cast("int"))
            .when(p.rlike("^[A-Za-z]$"), F.ascii(F.upper(p)) + 935)
            .when(roman > 0, roman + 2000)
            .otherwise(0)
        )

    return F.transform(F.split(section, r"[.\-]"), part)


def sort_key(section: Column, width: int = 8) -> Column:
    """Text that sorts as the parts do, blank labels last."""
    parts = F.slice(F.concat(section_parts(section), F.array_repeat(F.lit(0), width)), 1, width)
    return F.when(F.coalesce(section, F.lit("")) == "", "~").otherwise(F.array_join(F.transform(parts, lambda x: F.lpad(x.cast("string"), 10, "0")), "."))


def parent_section(section: Column) -> Column:
    """Label without its last dotted part; a label without a dot is its own parent."""
    return F.regexp_replace(section, r"\.[^.]*\z", "")


def subsection_key(section: Column) -> Column:
    return F.substring_index(section, ".", 2)


def locale_key(text: Column, locale: str = "UNICODE") -> Column:
    """Sorts as people read: accents and case count only where letters are equal, signs come before digits, digits before letters.

    Words with a sharp s against words that differ by an accent may come in another order than in other builds of ICU.
    """
    return F.collate(text, locale)


def code_unit_key(text: Column) -> Column:
    """Sorts by UTF-16 code units, in which letters beyond the first plane come before U+E000 to U+FFFF."""
    return F.encode(text, "UTF-16BE")


def category_keys(category: Column) -> list[Column]:
    """Sort keys of categories: those that begin with a number by that number, all others behind them in locale order.

    Comparing pairs, two by number and others by locale, gives no order where signs come before digits; this is one.
    """
    number = F.regexp_extract(category, r"^\s*([0-9]{1,18})", 1).try_cast("long")
    return [number.asc_nulls_last(), F.when(number.isNull(), locale_key(category))]
