"""Rows from and to the outside: compact model output, section enrichment, export rows and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.functions.regexlib import matches
from reqloom.functions.rules import statement
from reqloom.functions.sections import major_category
from reqloom.functions.text import strip
from reqloom.operators.scoring import shortened

# Codes of the compact form.
TYPE_CODES = {1: "DECLARATIVE", 2: "DESCRIPTIVE", 3: "PROCEDURAL", 4: "QUANTITATIVE", 5: "REFERENCE_BASED", 6: "EVIDENCE_BASED", 7: "STAFFING", 8: "CONTEXTUAL"}
DOMAIN_CODES = {1: "FEATURE", 2: "PROCESS", 3: "LEGAL"}
COMPACT = "struct<dl: string, dt: string, r: array<struct<s: string, g: string, t: string, y: int, m: int, d: int, a: int, w: int, c: int>>>"


def coded(table: dict[int, str], code: Column, otherwise: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), code), F.lit(otherwise))


def decode(outputs: DataFrame, id_: str, answer: str) -> DataFrame:
    """A row for each requirement in a model's compact JSON answer, in order. What is behind a break in the JSON is lost, what is before it is kept."""
    whole = F.from_json(answer, COMPACT)
    started = F.regexp_extract(answer, r'(?s)"r"\s*:\s*\[(.*)', 1)
    salvaged = F.filter(F.transform(F.regexp_extract_all(started, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: F.from_json(x, "s string, g string, t string, y int, m int, d int, a int, w int, c int")), lambda x: x["t"].isNotNull())
    rows = outputs.select(id_, F.posexplode(F.coalesce(whole["r"], salvaged)).alias("ord", "x"))
    return rows.select(
        id_, "ord", F.col("x.s").alias("section"), F.col("x.g").alias("section_group"), F.col("x.t").alias("text"), coded(TYPE_CODES, F.col("x.y"), "DESCRIPTIVE").alias("type"),
        F.coalesce(F.col("x.m") == 1, F.lit(False)).alias("is_mandatory"), coded(DOMAIN_CODES, F.col("x.d"), "FEATURE").alias("domain_context"), F.coalesce(F.col("x.a") == 1, F.lit(False)).alias("is_attestation"),
    )


# Group labels that say no more than a key.
BARE_LABELS = (r"^([A-Z]|\d+|[IVXLC]+)[.:\)\s]*\z", r"^[A-Z]\d+\z", r"^[A-Z][.\-]\d", r"^\d+\.\d")


def enriched_group(section: Column, group: Column, title: Column) -> Column:
    """Group label with the document's title of its section, where the given one says no more than a key."""
    given = F.coalesce(group, F.lit(""))
    trimmed = strip(given)
    bare = (given == "") | (F.coalesce(section, F.lit("")) == given) | (~trimmed.contains(":") & (F.length(trimmed) < 20))
    for p in BARE_LABELS:
        bare = bare | matches(trimmed, p)
    key = major_category(F.coalesce(F.nullif(section, F.lit("")), group), False)
    better = F.when(title.isNotNull(), F.concat(key, F.lit(": "), title)).when(~given.contains(":"), key).otherwise(group)
    return F.when((F.coalesce(section, F.lit("")) == "") & (given == ""), group).when(bare, better).otherwise(group)


def filename(project: Column, label: str, day: Column, kind: str) -> Column:
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(project, "[^A-Za-z0-9]", "-"), "-+", "-"), r"^-|-\z", "")
    return F.concat(F.left(safe, F.lit(50)), F.lit(f"-{label}-"), F.date_format(day, "yyyy-MM-dd"), F.lit(f".{kind}"))


def export_rows(reqs: DataFrame, projects: DataFrame) -> DataFrame:
    """What an export holds of each requirement: no context rows, short text, the answer or the statement, and whether it is a non-compliance that blocks."""
    rows = reqs.where("type <> 'CONTEXTUAL'").join(projects.select("project_id", "company_name"), "project_id", "left")
    is_attestation = F.coalesce("is_attestation", F.lit(False))
    answer = F.when(is_attestation, statement(F.col("text"), F.col("company_name"), F.col("compliance_status"))).otherwise(F.coalesce("draft_answer", F.lit("")))
    against = is_attestation & F.coalesce(F.col("compliance_status") == "NON_COMPLIANT", F.lit(False))
    return rows.select("project_id", "requirement_id", shortened(F.col("text"), 100).alias("text"), answer.alias("answer"), (against & F.col("is_mandatory")).alias("blocks"), (against & ~F.col("is_mandatory")).alias("warns"))
