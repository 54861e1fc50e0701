"""Queries of decoding, enrichment and export, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.functions import rules as R
from reqloom.functions.regexlib import quoted
from reqloom.operators import exchange as X
from reqloom.operators import profile as P
from reqloom.operators.asking import profiles, refined
from reqloom.plans.corpus import PROJECTS_SQL, REQUIREMENTS_SQL, projects, requirements
from reqloom.plans.texts import chain_sql


def decoded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact JSON answers, one a project, a part of them broken off."""
    one = F.struct(F.col("section").alias("s"), F.col("text").alias("t"), (F.col("ord") % 10).cast("int").alias("y"), F.col("is_mandatory").cast("int").alias("m"), (F.col("ord") % 4).cast("int").alias("d"))
    rows = requirements(spark, sf_dir).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("o")))).alias("l"))
    said = F.to_json(F.struct(F.transform("l", lambda x: x["o"]).alias("r")))
    broken = F.when(F.col("project_id") % 3 == 0, F.substring(said, F.lit(1), F.length(said) - 3)).otherwise(said)
    return X.decode(rows.select("project_id", broken.alias("answer")), "project_id", "answer").select("project_id", "ord", "section", "text", "type", "is_mandatory", "domain_context")


_CASE = lambda codes, of, otherwise: f"case {of} {' '.join(f'when {k} then {quoted(v)}' for k, v in codes.items())} else '{otherwise}' end"
DECODED_SQL = f"""with {REQUIREMENTS_SQL}, n as (select *, (row_number() over (partition by project_id order by ord) - 1)::int as pos, count(*) over (partition by project_id) as k from requirements)
select project_id, pos as ord, section, text, {_CASE(X.TYPE_CODES, 'ord % 10', 'DESCRIPTIVE')} as type, is_mandatory, {_CASE(X.DOMAIN_CODES, 'ord % 4', 'FEATURE')} as domain_context
from n where project_id % 3 <> 0 or pos < k - 1"""


def enriched_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("requirement_id") % 3 == 0, "Given Title")
    return requirements(spark, sf_dir).select("requirement_id", F.coalesce(X.enriched_group(F.col("section"), F.col("section_group"), title), F.lit("")).alias("section_group"))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.export_rows(requirements(spark, sf_dir), projects(spark, sf_dir))


_COMPANY = "coalesce(nullif(company_name, ''), '[Company Name]')"
EXPORT_SQL = f"""with {REQUIREMENTS_SQL}, {PROJECTS_SQL} select project_id, requirement_id, case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as text,
  case when not coalesce(is_attestation, false) then coalesce(draft_answer, '') when compliance_status = 'COMPLIANT' then {_COMPANY} || ' ' || {chain_sql("text", R.STATEMENTS, quoted(R.GENERIC_STATEMENT))}
    when compliance_status = 'NON_COMPLIANT' then {_COMPANY} || ' notes non-compliance with this requirement.' when compliance_status = 'NOT_APPLICABLE' then 'Not applicable to ' || {_COMPANY} || '''s proposal.' else '' end as answer,
  coalesce(is_attestation and compliance_status = 'NON_COMPLIANT', false) and is_mandatory as blocks, coalesce(is_attestation and compliance_status = 'NON_COMPLIANT', false) and not is_mandatory as warns
from requirements left join projects using (project_id) where type <> 'CONTEXTUAL'"""


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("-"), "name", F.lit(" & Söhne / lot #"), F.col("project_id").cast("string"))
    return projects(spark, sf_dir).select("project_id", X.filename(name, "matrix", F.lit("2024-05-06").cast("date"), "docx").alias("filename"))


NAMES_SQL = f"""with {PROJECTS_SQL} select project_id, left(regexp_replace(regexp_replace(regexp_replace('-' || name || ' & Söhne / lot #' || project_id, '[^A-Za-z0-9]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 50) || '-matrix-2024-05-06.docx' as filename from projects"""

QUERIES = {"decoded_answers": (decoded_answers, DECODED_SQL), "enriched_groups": (enriched_groups, None), "export_rows": (export_rows, EXPORT_SQL), "export_names": (export_names, NAMES_SQL)}


def told(prompts: list[str]) -> str:
    """Stands in for a model: a kind by the first word, nothing for lists, and no reply where a text is cut short."""
    if any(p.startswith("Short") for p in prompts):
        raise TimeoutError("no reply")
    kinds = {"Describe": "DESCRIPTIVE", "Provide": "EVIDENCE_BASED", "Does": "DECLARATIVE", "What": "QUANTITATIVE", "All": "STAFFING"}
    return json.dumps({"r": [{"i": i, "type": kinds.get(p.split(" ")[0], "OTHER"), "mandatory": "optional" not in p.lower() if "?" not in p else None} for i, p in enumerate(prompts) if not p.startswith("Attach")]})


def refined_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of low confidence put to a stand-in, whose answers go back to their rows."""
    rows = requirements(spark, sf_dir).select("requirement_id", "text", "type", "is_mandatory", (F.col("ord") % 101).cast("int").alias("confidence"))
    out = refined(rows, told, F.col("text"), "requirement_id", tasks=int(spark.conf.get("spark.sql.shuffle.partitions")), wait=lambda s: None)
    return out.select("requirement_id", "type", "is_mandatory", "confidence", "answered")


REFINED_SQL = f"""with {REQUIREMENTS_SQL}, a as (select *, (ord % 101)::int as c, split_part(text, ' ', 1) as w, not starts_with(text, 'Short') and not starts_with(text, 'Attach') as answers from requirements)
select requirement_id, case when c >= 70 or not answers then type else coalesce(case w when 'Describe' then 'DESCRIPTIVE' when 'Provide' then 'EVIDENCE_BASED' when 'Does' then 'DECLARATIVE' when 'What' then 'QUANTITATIVE' when 'All' then 'STAFFING' end, type) end as type,
  case when c >= 70 or not answers or contains(text, '?') then is_mandatory else not contains(lower(text), 'optional') end as is_mandatory, case when c < 70 and answers then 95 else c end as confidence, case when c < 70 then answers end as answered from a"""
QUERIES["refined_types"] = (refined_types, REFINED_SQL)


def profile_told(prompt: str) -> str:
    """Stands in for a model: a profile by the first 100 characters; a bad one for some letters, no reply for others."""
    head = prompt[:100]
    first = head[:1].lower()
    if first in ("a", "e"):
        raise TimeoutError("no reply")
    families = {"n": "bracket", "t": "roman", "s": "spiral"}
    facts = {"hasTableOfContents": "CONTENTS" in head, "hasAppendices": None, "estimatedRequirementCount": head.count(" "), "documentType": "rfp" if "d" in head else "memo"}
    skipped = [{"title": head.split(" ")[0], "reason": "examples" if "r" in head else "taste"}, {"title": 7}]
    return json.dumps({
        "primaryPatternFamily": families.get(first, "numeric"), "secondaryPatternFamilies": ["outline", "numeric", "odd"], "requirementSectionPrefixes": ["3.", 4] if "3" in head else None,
        "skipSections": skipped, "metadata": {} if first == "o" else facts, "confidence": 40 + len(head),
    })


def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all documents as a stand-in gives them, held to their types."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = profiles(docs, profile_told, P.prompt(F.col("text")), tasks=int(spark.conf.get("spark.sql.shuffle.partitions")), wait=lambda s: None)
    skipped = F.array_join(F.transform("skipped", lambda x: F.concat(x["title"], F.lit(":"), F.coalesce(x["reason"], F.lit("-")))), ",")
    return made.select("doc_id", F.col("primary").alias("family"), F.array_join("families", ",").alias("families"), F.array_join("prefixes", ",").alias("prefixes"), skipped.alias("skipped"), "has_contents", "has_appendices", "expected", "document_type", "confidence")


PROFILE_SQL = """with h as (select doc_id, left(text, 100) as head, lower(left(text, 1)) as first from documents),
t as (select doc_id, head, case first when 'n' then 'bracket' when 't' then 'roman' else 'numeric' end as family from h where trim(head) <> '' and first not in ('a', 'e', 'o'))
select h.doc_id, family, case when family = 'numeric' then 'numeric,outline' else family || ',outline,numeric' end as families, case when family is not null then case when contains(t.head, '3') then '3.' else '' end end as prefixes,
  split_part(t.head, ' ', 1) || case when contains(t.head, 'r') then ':examples' else ':-' end as skipped, contains(t.head, 'CONTENTS') as has_contents, null::boolean as has_appendices,
  (length(t.head) - length(replace(t.head, ' ', '')))::bigint as expected, case when t.head is not null then case when contains(t.head, 'd') then 'rfp' else 'other' end end as document_type, case when t.head is not null then least(40 + length(t.head), 100) end::int as confidence
from h left join t using (doc_id)"""
QUERIES["document_profiles"] = (document_profiles, PROFILE_SQL)
