"""Requirement tables derived from orders and customer: one requirement an order, one project a customer.

Every column is a projection, written once for Spark and once in SQL. Residues of different primes keep the attributes apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS = (
    "Describe your approach to data protection.",
    "The vendor shall comply with all GDPR obligations.",
    "Does your system support single sign-on?",
    "Optional: list your offices.",
    "Describe any optional modules you offer.",
    "Provide your pricing for year one.",
    "What is the total cost of ownership over 5 years?",
    "Please outline the database schema.",
    "How do you handle GDPR requests?",
    "The contractor must hold a valid license.",
    "3.1.1 Provide search. 3.1.2 Provide export. 3.1.3 Provide import.",
    "SECTION OVERVIEW:",
    "Can business users edit templates?",
    "Can you explain how administrators edit templates?",
    "Is your product fully ADA compliant with WCAG 2.1?",
    "The solution must be hosted in accordance with FAR 52.204.",
    "A training plan is nice to have.",
    "Vendors may propose alternatives where applicable.",
    "This is critical for the project timeline.",
    "Attach a certificate of insurance | proof of liability coverage.",
    "Response [Col 2] text with [TABLE marker.",
    "aaaaaaaaaaaa repeated characters from a scan of the page",
    "Short.",
    "%% ## @@ ^^ && ** ~~ special ratio text with many signs ## @@ ^^ && **",
    "State your hourly rate in £100 steps and the budget.",
    "Describe your approach to pricing.",
    "Responses due: March 15, 2024 at noon.",
    "Submission date: 03/15/2024. Late answers are rejected.",
    "Deadline: 2024-03-15 for all lots.",
    "Must be received by: April 2, 2024 in writing.",
    "Do you have references from three clients?",
    "Are there any restrictions on exports?",
    "The system keeps audit logs and retention policy records.",
    "Include a diagram if possible.",
    "Provide screenshots if possible of the dashboard.",
    "All staff must pass a background check.",
    "The offeror shall submit two copies by the deadline.",
    "We accept all terms and conditions of the agreement.",
    "Bonus points for a mobile app.",
    "Encryption is required at rest and in transit.",
    "Explain your backup and disaster recovery process, including testing.",
    "What are your service levels and support hours?",
    "The supplier will be evaluated on experience.",
    "If the tool has an API, is it available?",
    "Nothing in particular is asked here",
    "See A.1.2 and B.2.1 together with 4.1 and 4.2.7.",
    "Where is the data hosted, and in which regions?",
    "",
)
SECTIONS = ("3.1.2", "10.1", "A.1", "IV.2", "Section 5: Security", "MANDATORY REQUIREMENTS", None, "2.3", "B-2", "a15", "VI, Annex")
GROUPS = ("3: Technical", None, "A. Company Profile", "Section 5: Security", "", "II. Terms", "10 Pricing")
DOMAINS = ("FEATURE", "PROCESS", "LEGAL", "FEATURE", "LEGAL")
TYPES = ("CONTEXTUAL", "PROCEDURAL", "DECLARATIVE", "DESCRIPTIVE", "EVIDENCE_BASED", "QUANTITATIVE", "REFERENCE_BASED", "STAFFING")
DRAFTS = (
    None,
    "",
    "We guarantee 100% uptime and best-in-class support.",
    "[COMPANY NAME] will deliver in [PROVIDE number] weeks. [DRAFT]",
    "It is worth noting that   the platform is fully compliant.  Moving forward, we always test.",
    "| Item | Value |\n|---|---|\n| SSO | yes |\n| Only |\n| a | b | c |",
    "Intro:\n• one\n• two\nNext paragraph\n\n\n\nEnd   ",
    "[CONFIRM SLA] and [confirm region] by [DATE]; see [Company name] [NUMBER].",
    "The quick and seamless rollout is always guaranteed.",
    "Short answer",
    "Additionally, rest assured, in fact, it works seamlessly with world-class tools.",
)
WORD_LIMITS = (None, 3, 10, 50, None)
CHAR_LIMITS = (None, 20, 200, 40, None, 1000, 12)
COMPLIANCE = ("PENDING", "COMPLIANT", None, "NON_COMPLIANT", "NOT_APPLICABLE")
CRITERIA = ((1, "Technical", 50, ("3", "10", "A")), (2, "Security", 30, ("Section 5", "IV")), (3, "Terms", 10, ("VI", "3")))


def _pick(values: tuple, modulus: int | None = None, kind: str | None = None) -> Column:
    """The value at o_orderkey modulo the number of values (or a larger modulus, folded)."""
    at = F.col("o_orderkey") % (modulus or len(values)) % len(values)
    return F.get(F.array(*[F.lit(v).cast(kind) if kind else F.lit(v) for v in values]), at.cast("int"))


def sql_literal(value) -> str:
    if value is None:
        return "null"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _pick_sql(values: tuple, modulus: int | None = None, kind: str = "varchar") -> str:
    return f"([{', '.join(sql_literal(v) for v in values)}]::{kind}[])[(o_orderkey % {modulus or len(values)} % {len(values)})::int + 1]"


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        key.alias("requirement_id"),
        F.col("o_custkey").alias("project_id"),
        key.alias("ord"),
        _pick(TEXTS).alias("text"),
        _pick(SECTIONS).alias("section"),
        _pick(GROUPS).alias("section_group"),
        F.when(F.col("o_orderstatus") == "F", "ANSWERED").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("UNANSWERED").alias("status"),
        F.substring("o_orderpriority", 1, 1).isin("1", "2", "3").alias("is_mandatory"),
        _pick(DOMAINS).alias("domain_context"),
        _pick(TYPES, 17).alias("type"),
        _pick(DRAFTS, 13).alias("draft_answer"),
        _pick(WORD_LIMITS, kind="int").alias("word_limit"),
        _pick(CHAR_LIMITS, kind="int").alias("character_limit"),
        F.when(key % 19 == 5, F.lit(None).cast("boolean")).otherwise(key % 7 == 3).alias("requires_review"),
        F.when(key % 23 == 4, F.lit(None).cast("boolean")).otherwise((key % 11).isin(2, 5)).alias("is_attestation"),
        _pick(COMPLIANCE, 29).alias("compliance_status"),
        F.col("o_orderdate").alias("created_at"),
    )


REQUIREMENTS_SQL = f"""requirements as (
  select o_orderkey as requirement_id, o_custkey as project_id, o_orderkey as ord,
    {_pick_sql(TEXTS)} as text, {_pick_sql(SECTIONS)} as section, {_pick_sql(GROUPS)} as section_group,
    case o_orderstatus when 'F' then 'ANSWERED' when 'P' then 'PARTIAL' else 'UNANSWERED' end as status,
    substr(o_orderpriority, 1, 1) in ('1', '2', '3') as is_mandatory,
    {_pick_sql(DOMAINS)} as domain_context, {_pick_sql(TYPES, 17)} as type, {_pick_sql(DRAFTS, 13)} as draft_answer,
    {_pick_sql(WORD_LIMITS, kind="int")} as word_limit, {_pick_sql(CHAR_LIMITS, kind="int")} as character_limit,
    case when o_orderkey % 19 = 5 then null else o_orderkey % 7 = 3 end as requires_review,
    case when o_orderkey % 23 = 4 then null else o_orderkey % 11 in (2, 5) end as is_attestation,
    {_pick_sql(COMPLIANCE, 29)} as compliance_status, o_orderdate as created_at
  from orders
)"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).when(F.col("c_custkey") % 4 == 1, "").otherwise(F.col("c_name"))
    status = F.get(F.array(*[F.lit(s) for s in ("READY", "PROCESSING", "COMPLETED", "FAILED")]), (F.col("c_custkey") % 4).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("user_id"), company.alias("company_name"), status.alias("status"))


PROJECTS_SQL = """projects as (
  select c_custkey as project_id, c_name as name, c_nationkey as user_id,
    case c_custkey % 4 when 0 then null when 1 then '' else c_name end as company_name,
    (['READY', 'PROCESSING', 'COMPLETED', 'FAILED'])[(c_custkey % 4)::int + 1] as status
  from customer
)"""


def criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, w, list(s)) for i, n, w, s in CRITERIA], "criterion_id int, name string, weight int, linked_sections array<string>")


CRITERIA_SQL = "criteria as (select * from (values " + ", ".join(f"({i}, '{n}', {w}, [{', '.join(map(sql_literal, s))}])" for i, n, w, s in CRITERIA) + ") as t(criterion_id, name, weight, linked_sections))"
