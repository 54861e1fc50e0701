"""Queries of the requirement matrix, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions import sections as S
from reqloom.operators import filters, scoring
from reqloom.plans.corpus import CRITERIA_SQL, PROJECTS_SQL, REQUIREMENTS_SQL, criteria, projects, requirements

W10 = "(case when is_mandatory then 2 else 1 end * case domain_context when 'LEGAL' then 15 when 'PROCESS' then 12 else 10 end)"
C2 = "(case status when 'ANSWERED' then 2 when 'PARTIAL' then 1 else 0 end)"
LABEL = "coalesce(nullif(section_group, ''), section)"
DRAFT = "coalesce(draft_answer, '')"
WORDS = f"len(list_filter(regexp_split_to_array({DRAFT}, '\\s+'), lambda w: w <> ''))"
OVER = f"({DRAFT} <> '' and (coalesce({WORDS} > word_limit, false) or coalesce(length({DRAFT}) > character_limit, false)))"
PREFIX = r"^(Section|Part|Chapter|Article)\s+(\d+|[A-Z]+)"


def score_sql(earned: str, whole: str, empty: int = 100) -> str:
    return f"(case when coalesce({whole}, 0) > 0 then floor(({earned})::double / ({whole})::double * 100 + 0.5) else {empty} end)::bigint"


WEIGHTED = score_sql(f"sum({W10} * {C2})", f"sum({W10} * 2)")
MANDATORY = score_sql(f"sum({C2}) filter (is_mandatory)", "count(*) filter (is_mandatory) * 2")


def category_sql(section: str) -> str:
    plain = lambda s: f"""case when regexp_matches({s}, '^[0-9]') then regexp_extract({s}, '^([0-9]+)', 1)
        when regexp_matches({s}, '^[A-Za-z]') and not regexp_matches({s}, '^[A-Za-z][A-Za-z]') then upper({s}[1])
        when regexp_matches({s}, '^(?i:([IVX]+)([^A-Z]|$))') then upper(regexp_extract({s}, '^(?i:([IVX]+)([^A-Z]|$))', 1)) else {s} end"""  # noqa: E731
    s = f"trim({section})"
    head = f"trim(split_part({s}, ',', 1))"
    named = lambda x: f"regexp_extract({x}, '(?i){PREFIX}', 1) || ' ' || regexp_extract({x}, '(?i){PREFIX}', 2)"
    return f"""(case when coalesce({s}, '') = '' then 'Uncategorized' when regexp_matches({s}, '(?i){PREFIX}') then {named(s)}
      when contains({s}, ',') then case when {head} = '' then 'Uncategorized' when regexp_matches({head}, '(?i){PREFIX}') then {named(head)} else {plain(head)} end
      else {plain(s)} end)"""


def compliance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summary(requirements(spark, sf_dir))


SUMMARY_SQL = f"""with {REQUIREMENTS_SQL}, s as (
  select project_id, count(*) as total, count(*) filter (status = 'ANSWERED') as answered, count(*) filter (status = 'PARTIAL') as partial,
    count(*) filter (status = 'UNANSWERED') as unanswered, {WEIGHTED} as overall, {MANDATORY} as mandatory from requirements group by project_id
) select *, case when overall >= 90 then 'A' when overall >= 80 then 'B' when overall >= 70 then 'C' when overall >= 60 then 'D' else 'F' end as grade,
  case when overall >= 80 then 'high' when overall >= 60 then 'medium' when overall >= 40 then 'low' else 'none' end as band from s"""


def section_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.section_scores(requirements(spark, sf_dir))


SECTION_SQL = f"""with {REQUIREMENTS_SQL} select project_id, {category_sql(LABEL)} as category, count(*) as total,
  count(*) filter (status = 'ANSWERED') as answered, {WEIGHTED} as score from requirements group by all"""


def domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.domain_scores(requirements(spark, sf_dir))


DOMAIN_SQL = f"with {REQUIREMENTS_SQL} select project_id, " + ", ".join(
    score_sql(f"sum({W10} * {C2}) filter (domain_context = '{d}')", f"sum({W10} * 2) filter (domain_context = '{d}')") + f" as {d.lower()}" for d in scoring.DOMAINS
) + " from requirements group by project_id"


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.readiness(requirements(spark, sf_dir), projects(spark, sf_dir))


_RULES = {
    "mandatory_unanswered": (True, "is_mandatory and status = 'UNANSWERED'"),
    "legal_unreviewed": (True, "domain_context = 'LEGAL' and requires_review"),
    "over_limit": (True, OVER),
    "mandatory_partial": (False, "is_mandatory and status = 'PARTIAL'"),
    "needs_review": (False, "requires_review and domain_context <> 'LEGAL'"),
}
READINESS_SQL = f"""with {REQUIREMENTS_SQL}, {PROJECTS_SQL}, hits as (""" + " union all ".join(
    f"select project_id, '{name}' as rule, {blocker} as blocker, count(*) as number, string_agg(requirement_id::varchar, ',' order by requirement_id) as ids from requirements where {test} group by project_id"
    for name, (blocker, test) in _RULES.items()
) + f"""), facts as (select project_id, {score_sql("count(*) filter (status = 'ANSWERED')", "count(*)")} as rate from requirements group by project_id
), issues as (
  select * from hits union all select project_id, 'low_completion', false, rate, '' from facts where rate < 80
  union all select f.project_id, 'missing_company_name', false, 0, '' from facts f left join projects p using (project_id) where coalesce(p.company_name, '') = ''
) select project_id, not exists (select 1 from hits h where h.project_id = i.project_id and h.blocker) as ready, rule, blocker, number, ids from issues i"""


def criterion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.criterion_scores(requirements(spark, sf_dir), criteria(spark))


_LINKED = f"linked as (select r.*, c.criterion_id, c.weight from requirements r join (select criterion_id, weight, unnest(linked_sections) as category from criteria) c on c.category = {category_sql('r.section')})"
_CRITERION = f"""scored as (select project_id, criterion_id, {WEIGHTED} as score, count(*) as requirements, count(*) filter (status = 'ANSWERED') as answered from linked group by all),
  criterion as (select p.project_id, c.criterion_id, c.name, c.weight, coalesce(s.score, 100)::bigint as score, coalesce(s.requirements, 0) as requirements, coalesce(s.answered, 0) as answered
  from (select distinct project_id from requirements) p cross join criteria c left join scored s on s.project_id = p.project_id and s.criterion_id = c.criterion_id)"""
CRITERION_SQL = f"with {REQUIREMENTS_SQL}, {CRITERIA_SQL}, {_LINKED}, {_CRITERION} select * from criterion"


def criteria_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.criteria_overall(requirements(spark, sf_dir), criteria(spark))


OVERALL_SQL = f"""with {REQUIREMENTS_SQL}, {CRITERIA_SQL}, {_LINKED}, {_CRITERION},
used as (select project_id, sum(score * weight) as earned, sum(weight) as used from criterion where requirements > 0 group by project_id),
rest as (select project_id, {WEIGHTED} as rest from requirements where {category_sql('section')} not in (select unnest(linked_sections) from criteria) group by project_id),
a as (select p.project_id, coalesce(earned, 0) as earned, coalesce(used, 0) as used, rest from (select distinct project_id from requirements) p left join used using (project_id) left join rest using (project_id)),
b as (select project_id, earned + case when rest is not null and used < 100 then rest * (100 - used) else 0 end as earned, case when rest is not null and used < 100 then 100 else used end as whole from a)
select project_id, (case when whole > 0 then floor(earned::double / whole::double + 0.5) else 100 end)::bigint as overall from b"""


def what_if_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_impact(requirements(spark, sf_dir)).select("project_id", "requirement_id", "status", "impact")


_IMPACT = f"""t as (select *, sum({W10} * {C2}) over p as e, sum({W10} * 2) over p as w from requirements window p as (partition by project_id)),
impact as (select * exclude (e, w), (case when status = 'ANSWERED' then 0 else greatest(0,
  floor((e + {W10} * (2 - {C2}))::double / w::double * 100 + 0.5) - floor(e::double / w::double * 100 + 0.5)) end)::bigint as impact from t)"""
IMPACT_SQL = f"with {REQUIREMENTS_SQL}, {_IMPACT} select project_id, requirement_id, status, impact from impact"


def focus_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.focus_items(requirements(spark, sf_dir))


_FOCUS = f"""focus as (select project_id, rank::int as rank, requirement_id, case when length(text) > 80 then substr(text, 1, 80) || '...' else text end as text, nullif(section, '') as section, is_mandatory, impact,
  case when is_mandatory and domain_context = 'LEGAL' then 'Mandatory, Legal requirement' when is_mandatory then 'Mandatory' when domain_context = 'LEGAL' then 'Legal requirement' else 'Standard weight' end as reason
  from (select *, row_number() over (partition by project_id order by impact desc, is_mandatory desc, ord) as rank from impact where status <> 'ANSWERED') where rank <= 5)"""
FOCUS_SQL = f"with {REQUIREMENTS_SQL}, {_IMPACT}, {_FOCUS} select * from focus"


def potential_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.potential(requirements(spark, sf_dir))


POTENTIAL_SQL = f"with {REQUIREMENTS_SQL}, {_IMPACT}, {_FOCUS} select project_id, sum(impact)::bigint as potential from focus group by project_id"


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.insights(requirements(spark, sf_dir), criteria(spark))


INSIGHTS_SQL = f"""with {REQUIREMENTS_SQL}, {CRITERIA_SQL}, {_LINKED},
heavy as (select project_id, criterion_id, count(*) as n, count(*) filter (status = 'ANSWERED') as done from linked where weight >= 20 group by all),
i as (
  select project_id, 'risk' as kind, 'high' as priority, criterion_id, n - done as number from heavy where {score_sql('done', 'n')} < 50
  union all select project_id, 'over_limit', 'medium', 0, count(*) from requirements where {OVER} group by project_id
  union all select project_id, 'attestation_pending', 'low', 0, count(*) from requirements where is_attestation and compliance_status = 'PENDING' and status <> 'ANSWERED' group by project_id
) select *, (row_number() over (partition by project_id order by case priority when 'high' then 0 when 'medium' then 1 else 2 end, criterion_id))::int as place from i"""


def category_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.title_map(requirements(spark, sf_dir))


_TITLES = (
    (r"^(?i:([A-Z])[.:\-]\s*(.+)$)", 1, 2),
    (r"^(?i:([A-Z])\s+([A-Z][A-Za-z\s,&\-]+)$)", 1, 2),
    (r"^(\d+)[.\s:\-]+\s*([A-Za-z].+)$", 1, 2),
    (r"^(?i:((?:Section|Part|Chapter|Article)\s+(?:\d+|[A-Z]+))[.\s:\-]+\s*([A-Za-z].+)$)", 1, 2),
    (r"^(?i:([IVX]+)[.:\-]\s*(.+)$)", 1, 2),
)
_TITLE = "coalesce(" + ", ".join(f"case when regexp_matches(trim(label), '{p}') and upper(regexp_extract(trim(label), '{p}', {k})) = upper(category) then trim(regexp_extract(trim(label), '{p}', {t})) end" for p, k, t in _TITLES) + ")"
TITLES_SQL = f"""with {REQUIREMENTS_SQL}, l as (select project_id, ord, {LABEL} as label, {category_sql(LABEL)} as category from requirements where coalesce({LABEL}, '') <> ''),
t as (select *, {_TITLE} as title from l)
select project_id, category, coalesce(category || ': ' || (arg_min(title, ord) filter (title is not null)), category) as title from t group by project_id, category"""


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.progress(requirements(spark, sf_dir))


PROGRESS_SQL = f"""with {REQUIREMENTS_SQL} select project_id, {score_sql("count(*) filter (status = 'ANSWERED')", "count(*)", 0)} as overall,
  {score_sql("count(*) filter (is_mandatory and status = 'ANSWERED')", "count(*) filter (is_mandatory)")} as mandatory, {score_sql(f"sum({C2})", "count(*) * 2")} as completion from requirements group by project_id"""

SOME = filters.Filters(statuses=["UNANSWERED", "PARTIAL"], mandatory=True, domains=["FEATURE", "LEGAL"], needs_review=False, has_draft=True, over_limit=False, search="WE")
SOME_SQL = f"status in ('UNANSWERED', 'PARTIAL') and is_mandatory and coalesce(domain_context, 'FEATURE') in ('FEATURE', 'LEGAL') and not coalesce(requires_review, false) and {DRAFT} <> '' and not {OVER} and (contains(lower(text), 'we') or contains(lower({DRAFT}), 'we'))"
OTHER = filters.Filters(types=["DESCRIPTIVE", "STAFFING", "QUANTITATIVE"], attestation=False, compliance=["PENDING", "COMPLIANT"], over_limit=True)
OTHER_SQL = f"type in ('DESCRIPTIVE', 'STAFFING', 'QUANTITATIVE') and not coalesce(is_attestation, false) and coalesce(compliance_status, 'PENDING') in ('PENDING', 'COMPLIANT') and {OVER}"


def filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs = requirements(spark, sf_dir)
    pick = lambda f, name: filters.apply_filters(reqs, f).select(F.lit(name).alias("filter"), "requirement_id", "status", "type", "draft_answer")
    return pick(SOME, "some").unionByName(pick(OTHER, "other"))


FILTER_SQL = f"with {REQUIREMENTS_SQL} " + " union all ".join(f"select '{n}' as filter, requirement_id, status, type, draft_answer from requirements where {c}" for n, c in (("some", SOME_SQL), ("other", OTHER_SQL)))


def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_counts(requirements(spark, sf_dir), SOME)


COUNTS_SQL = f"with {REQUIREMENTS_SQL} select project_id, count(*) as total, count(*) filter ({SOME_SQL}) as filtered, " + ", ".join(
    f"count(*) filter ({f'coalesce({c}, {chr(39)}{d}{chr(39)})' if d else c} = '{v}') as {v.lower()}" for c, values, d in filters.FACETS for v in values
) + f""", count(*) filter (is_mandatory) as mandatory, count(*) filter (requires_review) as needs_review, count(*) filter ({OVER}) as over_limit,
  count(*) filter ({DRAFT} <> '') as has_draft, count(*) filter (is_attestation) as attestation, count(*) filter (not coalesce(is_attestation, false)) as written_response from requirements group by project_id"""


def section_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = requirements(spark, sf_dir).withColumn("category", S.major_category(scoring.group_label())).where("category <> 'Uncategorized'")
    answered = F.count_if(F.col("status") == "ANSWERED")
    return keyed.groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("total"), answered.alias("answered"), scoring.percent(answered, F.count(F.lit(1)), 0).alias("percent"))


STATS_SQL = f"""with {REQUIREMENTS_SQL}, k as (select *, {category_sql(LABEL)} as category from requirements) select project_id, category, count(*) as total,
  count(*) filter (status = 'ANSWERED') as answered, {score_sql("count(*) filter (status = 'ANSWERED')", "count(*)", 0)} as percent from k where category <> 'Uncategorized' group by all"""


def matrix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each row in its project under each of the five sort options."""
    reqs = requirements(spark, sf_dir)
    rank = F.when(F.col("status") == "UNANSWERED", 0).when(F.col("status") == "PARTIAL", 1).otherwise(2)
    orders = {"by_order": ["ord"], "by_mandatory": [F.desc("is_mandatory"), "ord"], "by_status": [rank, "ord"], "by_section": [F.coalesce("section", F.lit("")), "ord"], "by_type": ["type", "ord"]}
    return reqs.select("project_id", "requirement_id", *[F.row_number().over(Window.partitionBy("project_id").orderBy(*o)).alias(n) for n, o in orders.items()])


SORT_SQL = f"""with {REQUIREMENTS_SQL} select project_id, requirement_id, """ + ", ".join(
    f"(row_number() over (partition by project_id order by {o}))::int as {n}"
    for n, o in {"by_order": "ord", "by_mandatory": "is_mandatory desc, ord", "by_status": "case status when 'UNANSWERED' then 0 when 'PARTIAL' then 1 else 2 end, ord", "by_section": "coalesce(section, ''), ord", "by_type": "type, ord"}.items()
) + " from requirements"


def locale_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each row in its project by section, type and text in locale order, and of its category among the project's."""
    label = F.coalesce(F.nullif(F.col("section_group"), F.lit("")), F.col("section"))
    reqs = requirements(spark, sf_dir).withColumn("category", S.major_category(label))
    project = Window.partitionBy("project_id")
    place = lambda c: F.row_number().over(project.orderBy(S.locale_key(F.coalesce(c, F.lit(""))), "ord"))
    mixed = F.when(F.col("ord") % 2 == 0, F.upper("text")).otherwise(F.col("text"))
    category = F.dense_rank().over(project.orderBy(*S.category_keys(F.col("category"))))
    return reqs.select("project_id", "requirement_id", place(F.col("section")).alias("by_section"), place(F.col("type")).alias("by_type"), place(mixed).alias("by_text"), "category", category.alias("category_place"))


LOCALE_SQL = f"""with {REQUIREMENTS_SQL}, c as (select *, {category_sql(LABEL)} as category, case when ord % 2 = 0 then upper(text) else text end as mixed from requirements),
k as (select *, try_cast(nullif(regexp_extract(category, '^\\s*([0-9]{{1,18}})', 1), '') as bigint) as number from c)
select project_id, requirement_id, (row_number() over (partition by project_id order by coalesce(section, '') collate en, ord))::int as by_section,
  (row_number() over (partition by project_id order by coalesce(type, '') collate en, ord))::int as by_type, (row_number() over (partition by project_id order by coalesce(mixed, '') collate en, ord))::int as by_text,
  category, (dense_rank() over (partition by project_id order by number nulls last, (case when number is null then category end) collate en))::int as category_place from k"""


def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section labels with their keys, and their place in section order."""
    labels = requirements(spark, sf_dir).select("project_id", "requirement_id", "section")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(S.sort_key(F.col("section")), "requirement_id"))
    return labels.select("project_id", "requirement_id", "section", S.major_category(F.col("section"), False).alias("category"), S.parent_section(F.col("section")).alias("parent"), S.subsection_key(F.col("section")).alias("subsection"), place.alias("place"))


_ROMAN = "{" + ", ".join(f"'{r}': {i}" for i, r in enumerate(S.ROMAN, 1)) + "}"
_PART = f"""case when regexp_matches(p, '^\\s*[0-9]') then regexp_extract(p, '^\\s*([0-9]+)', 1)::int when regexp_matches(p, '^[A-Za-z]$') then ascii(upper(p)) + 935
  when list_position({list(S.ROMAN)}, upper(p)) > 0 then 2000 + list_position({list(S.ROMAN)}, upper(p)) else 0 end"""
_PLAIN = category_sql("section").replace("when contains(trim(section), ',')", "when false").replace(f"when regexp_matches(trim(section), '(?i){PREFIX}')", "when false")
ORDER_SQL = f"""with {REQUIREMENTS_SQL}, k as (select *, case when coalesce(section, '') = '' then '~' else
  array_to_string(list_transform(list_resize(list_transform(regexp_split_to_array(section, '[.\\-]'), lambda p: {_PART}), 8, 0), lambda x: lpad(x::varchar, 10, '0')), '.') end as key from requirements)
select project_id, requirement_id, section, {_PLAIN} as category, regexp_replace(section, '\\.[^.]*$', '') as parent, array_to_string(list_slice(string_split(section, '.'), 1, 2), '.') as subsection,
  (row_number() over (partition by project_id order by key, requirement_id))::int as place from k"""


def qa_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-and-answer layout: groups by section in order of first appearance, rows in order."""
    rows = requirements(spark, sf_dir).where("type <> 'CONTEXTUAL'").withColumn("heading", F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("General")))
    groups = rows.groupBy("project_id", "heading").agg(F.min("ord").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda x: x.cast("string")), ",").alias("rows"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("first"))
    return groups.select("project_id", place.alias("place"), "heading", "rows")


QA_SQL = f"""with {REQUIREMENTS_SQL}, g as (select project_id, coalesce(nullif(section, ''), 'General') as heading, min(ord) as first, string_agg(ord::varchar, ',' order by ord) as rows from requirements where type <> 'CONTEXTUAL' group by all)
select project_id, (row_number() over (partition by project_id order by first))::int as place, heading, rows from g"""


QUERIES = {
    "compliance_summary": (compliance_summary, SUMMARY_SQL),
    "section_scores": (section_scores, SECTION_SQL),
    "domain_scores": (domain_scores, DOMAIN_SQL),
    "readiness": (readiness, READINESS_SQL),
    "criterion_scores": (criterion_scores, CRITERION_SQL),
    "criteria_overall": (criteria_overall, OVERALL_SQL),
    "what_if_impact": (what_if_impact, IMPACT_SQL),
    "focus_items": (focus_items, FOCUS_SQL),
    "potential_improvement": (potential_improvement, POTENTIAL_SQL),
    "insights": (insights, INSIGHTS_SQL),
    "category_titles": (category_titles, TITLES_SQL),
    "progress": (progress, PROGRESS_SQL),
    "filter_rows": (filter_rows, FILTER_SQL),
    "filter_counts": (filter_counts, COUNTS_SQL),
    "section_stats": (section_stats, STATS_SQL),
    "matrix_sort": (matrix_sort, SORT_SQL),
    "locale_orders": (locale_orders, LOCALE_SQL),
    "section_order": (section_order, ORDER_SQL),
    "qa_groups": (qa_groups, QA_SQL),
}
