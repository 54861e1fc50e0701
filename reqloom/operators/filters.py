"""The requirement filter: optional predicates, their conjunction, and facet counts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.operators.scoring import over_limit


@dataclass(frozen=True)
class Filters:
    """Empty lists, None and an empty search text filter nothing."""

    statuses: list[str] = field(default_factory=list)
    mandatory: bool | None = None
    domains: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    needs_review: bool | None = None
    over_limit: bool | None = None
    has_draft: bool | None = None
    attestation: bool | None = None
    compliance: list[str] = field(default_factory=list)
    search: str = ""


def contains_any_case(text: str, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))


def condition(f: Filters) -> Column:
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    tests = [
        F.col("status").isin(f.statuses) if f.statuses else None,
        F.col("is_mandatory") == f.mandatory if f.mandatory is not None else None,
        F.coalesce("domain_context", F.lit("FEATURE")).isin(f.domains) if f.domains else None,
        F.col("type").isin(f.types) if f.types else None,
        flag("requires_review") == f.needs_review if f.needs_review is not None else None,
        over_limit() == f.over_limit if f.over_limit is not None else None,
        (F.coalesce("draft_answer", F.lit("")) != "") == f.has_draft if f.has_draft is not None else None,
        flag("is_attestation") == f.attestation if f.attestation is not None else None,
        F.coalesce("compliance_status", F.lit("PENDING")).isin(f.compliance) if f.compliance else None,
        contains_any_case("text", f.search) | contains_any_case("draft_answer", f.search) if f.search else None,
    ]
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def apply_filters(reqs: DataFrame, f: Filters) -> DataFrame:
    return reqs.where(condition(f))


FACETS = (
    ("status", ("UNANSWERED", "PARTIAL", "ANSWERED"), None),
    ("domain_context", ("FEATURE", "PROCESS", "LEGAL"), "FEATURE"),
    ("type", ("CONTEXTUAL", "PROCEDURAL", "DECLARATIVE", "DESCRIPTIVE", "EVIDENCE_BASED", "QUANTITATIVE", "REFERENCE_BASED", "STAFFING"), None),
    ("compliance_status", ("PENDING", "COMPLIANT", "NON_COMPLIANT", "NOT_APPLICABLE"), "PENDING"),
)


def filter_counts(reqs: DataFrame, f: Filters) -> DataFrame:
    """Facets over all rows (zeros included) and the number of filtered rows, per project, in one pass."""
    cells = [F.count_if((F.coalesce(c, F.lit(default)) if default else F.col(c)) == v).alias(v.lower()) for c, values, default in FACETS for v in values]
    return reqs.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(condition(f)).alias("filtered"),
        *cells,
        F.count_if("is_mandatory").alias("mandatory"),
        F.count_if(F.coalesce("requires_review", F.lit(False))).alias("needs_review"),
        F.count_if(over_limit()).alias("over_limit"),
        F.count_if(F.coalesce("draft_answer", F.lit("")) != "").alias("has_draft"),
        F.count_if(F.coalesce("is_attestation", F.lit(False))).alias("attestation"),
        F.count_if(~F.coalesce("is_attestation", F.lit(False))).alias("written_response"),
    )
