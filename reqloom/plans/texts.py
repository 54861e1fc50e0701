"""Queries of text normalisation, drafts and rule engines, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.functions import rules as R
from reqloom.functions import text as N
from reqloom.functions.kinds import answer_kind, best_keywords, keyword_scores
from reqloom.functions.regexlib import any_of_sql, let, quoted, replaced_sql
from reqloom.plans.corpus import PROJECTS_SQL, REQUIREMENTS_SQL, projects, requirements


def joined(c) -> object:
    return F.array_join(c, ",")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def chain_sql(text: str, table, otherwise) -> str:
    lit = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return "case " + " ".join(f"when regexp_matches({text}, {quoted(p)}, 'i') then {lit(v)}" for p, v in table) + f" else {otherwise} end"


def obligation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.obligation(F.col("text"), F.col("section"))
    out = requirements(spark, sf_dir).select("requirement_id", (c > 0).alias("mandatory"), F.abs(c).alias("confidence"))
    return out.withColumn("needs_refinement", F.col("confidence") < 70)


_T = strip_sql("text")
_OPT = chain_sql(_T, [(p, -c) for p, c in R.OPTIONAL], 0)
_SEC = chain_sql("coalesce(section, '')", [*[(p, -c) for p, c in R.SECTION_OPTIONAL], *R.SECTION_MANDATORY], 0)
OBLIGATION_SQL = f"""with {REQUIREMENTS_SQL}, a as (select requirement_id, {_SEC} as s, {_OPT} as o, {chain_sql(_T, R.MANDATORY, R.DEFAULT_OBLIGATION)} as m, {any_of_sql("text", R.OPTIONAL_CONTENT, "i")} as content from requirements),
b as (select requirement_id, case when s <> 0 then s when not content and o <> 0 then o else m end as c from a)
select requirement_id, c > 0 as mandatory, abs(c)::int as confidence, abs(c) < 70 as needs_refinement from b"""


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requirements(spark, sf_dir).select("requirement_id", R.domain(F.col("text")).alias("domain"))


_words = lambda ws: tuple(map(R.word_pattern, ws))
DOMAIN_SQL = f"""with {REQUIREMENTS_SQL}, t as (select requirement_id, lower(text) as t from requirements)
select requirement_id, case when {any_of_sql("t", _words(R.STRONG_LEGAL), "")} or {' + '.join(f"regexp_matches(t, {quoted(p)})::int" for p in _words(R.LEGAL_WORDS))} >= 2 then 'LEGAL'
  when {any_of_sql("t", R.STRONG_PROCESS, "")} or {any_of_sql("t", _words(R.PROCESS_WORDS), "")} or {any_of_sql("t", ("^how ", " how ", *R.HOW), "")} then 'PROCESS' else 'FEATURE' end as domain from t"""


def attestation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs = requirements(spark, sf_dir).join(projects(spark, sf_dir).select("project_id", "company_name"), "project_id", "left")
    kind = R.attestation(F.col("text"))
    confidence = F.element_at(F.create_map(*[F.lit(x) for pair in R.ATTEST_CONFIDENCE for x in pair]), kind)
    return reqs.select(
        "requirement_id",
        kind.alias("kind"),
        kind.isin("both", "attest", "regulation").alias("attestation"),
        confidence.alias("confidence"),
        R.statement(F.col("text"), F.col("company_name"), F.col("compliance_status")).alias("statement"),
        R.response_status(F.col("compliance_status")).alias("response_status"),
    )


_COMPANY = "coalesce(nullif(company_name, ''), '[Company Name]')"
ATTESTATION_SQL = f"""with {REQUIREMENTS_SQL}, {PROJECTS_SQL}, s as (select r.requirement_id, r.text, r.compliance_status, p.company_name, {any_of_sql("text", R.WRITTEN, "i")} as w,
  {any_of_sql("text", R.ATTEST, "i")} or (regexp_matches(text, {quoted(R.CAN_QUESTION)}, 'i') and not regexp_matches(text, {quoted(R.CAN_EXPLAIN)}, 'i')) as a,
  {any_of_sql("text", R.REGULATION, "i")} or {any_of_sql("text", R.REGULATION_EXACT, "")} as g from requirements r left join projects p using (project_id)),
k as (select *, case when w then 'written' when a and g then 'both' when a then 'attest' when g then 'regulation' else 'none' end as kind from s)
select requirement_id, kind, kind in ('both', 'attest', 'regulation') as attestation, (case kind {' '.join(f"when '{k}' then {c}" for k, c in R.ATTEST_CONFIDENCE)} end)::double as confidence,
  case compliance_status when 'COMPLIANT' then {_COMPANY} || ' ' || {chain_sql("text", R.STATEMENTS, quoted(R.GENERIC_STATEMENT))} when 'NON_COMPLIANT' then {_COMPANY} || ' notes non-compliance with this requirement.'
    when 'NOT_APPLICABLE' then 'Not applicable to ' || {_COMPANY} || '''s proposal.' else '' end as statement,
  case when compliance_status in ('COMPLIANT', 'NON_COMPLIANT', 'NOT_APPLICABLE') then 'ANSWERED' else 'UNANSWERED' end as response_status from k"""


def type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.concat("type", F.when(F.col("requirement_id") % 9 == 0, "X").otherwise(""))
    return requirements(spark, sf_dir).select(
        "requirement_id", R.corrected_type(F.col("text"), F.col("type")).alias("corrected"), R.valid_type(kind).alias("valid"), R.old_type(F.lower(kind)).alias("old"), R.valid_domain(F.col("domain_context")).alias("domain")
    )


_KIND = "type || case when requirement_id % 9 = 0 then 'X' else '' end"
TYPE_SQL = f"""with {REQUIREMENTS_SQL} select requirement_id, case when type = 'DESCRIPTIVE' and {any_of_sql("text", R.FINANCIAL, "i")} and not {any_of_sql("text", R.ABOUT_PROCESS, "i")}
  and ({any_of_sql("text", R.ASKS_NUMBERS, "i")} or {any_of_sql("text", (R.CURRENCY,), "")}) then 'QUANTITATIVE' else type end as corrected,
  case when ({_KIND}) in {R.TYPES} then {_KIND} else 'DESCRIPTIVE' end as valid, case when upper({_KIND}) in {R.OLD_TYPES} then upper({_KIND}) else 'DECLARATIVE' end as old, domain_context as domain from requirements"""


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review reasons of all documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", joined(R.review_reasons(F.col("text"))).alias("reasons"))


_REASON_TESTS = (
    r"regexp_matches(text, '\[Col\s*\d*\]?|\[ROW\s*\d*\]?|\[TABLE|\[HEADER\]', 'i')",
    r"regexp_matches(text, '\s\|\s|^\s*\||\|\s*$')",
    f"regexp_matches(text, '{R.BOXES}')",
    f"length({strip_sql('text')}) < 25",
    f"len(regexp_extract_all(text, {quoted(R.SECTION_NUMBER)})) > 2",
    f"length(text) > 50 and len(regexp_extract_all(text, {quoted(R.SPECIAL)})) * 10 > length(text)",
    "false",
)
#: The engine that checks has no back-references: the last reason is left out on both sides.
REVIEW_SQL = "select doc_id, array_to_string(list_filter([" + ", ".join(f"case when {t} then '{r}' end" for t, r in zip(_REASON_TESTS, R.REASONS, strict=True)) + "], lambda x: x is not null), ',') as reasons from documents"


_SAME = " and ".join(f"c[i] = c[i + {k}]" for k in range(1, 6))
_LAST = f"len(list_filter(range(1, len(c) - 4), lambda i: {_SAME} and c[i] not in ('_', '-'))) > 0"
#: Without back-references: six equal characters in a row, of the text as a list.
REVIEW_ALL_SQL = "select doc_id, array_to_string(list_filter([" + ", ".join(f"case when {t} then '{r}' end" for t, r in zip((*_REASON_TESTS[:-1], _LAST), R.REASONS, strict=True)) + "], lambda x: x is not null), ',') as reasons from (select doc_id, text, string_split(text, '') as c from documents)"


def review_flags_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(R.review_reasons(F.col("text")), lambda x: x != R.REASONS[-1])
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", joined(found).alias("reasons"))


def template_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = R.template(F.col("text"))
    return requirements(spark, sf_dir).select("requirement_id", name.alias("template"), name.isNotNull().alias("has_template"))


_BY_PATTERN = "case " + " ".join(f"when {any_of_sql('text', ps, 'i')} then '{n}'" for n, ps, _, _ in R.TEMPLATES) + " end"
_SHARES = ", ".join(f"({i}, '{n}', ({' + '.join(f'contains(lower(text), {quoted(k.lower())})::int' for k in ks)}) / {len(ks)}.0::double, {least})" for i, (n, _, ks, least) in enumerate(R.TEMPLATES))
TEMPLATE_SQL = f"""with {REQUIREMENTS_SQL}, t as (select distinct text from requirements), k as (select t.text, s.* from t, lateral (values {_SHARES}) as s(i, name, share, least)),
b as (select text, (arg_max(name, share * 1000 - i) filter (share >= least)) as best from k group by text),
n as (select r.requirement_id, coalesce({_BY_PATTERN.replace("text", "r.text")}, b.best) as template from requirements r join b on b.text = r.text)
select *, template is not null as has_template from n"""


def placeholder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requirements(spark, sf_dir).select("project_id", "requirement_id", "text", F.explode(R.placeholders(F.col("draft_answer"))).alias("p"))
    return rows.groupBy("project_id", F.col("p.kind").alias("kind"), F.col("p.critical").alias("critical")).agg(F.count(F.lit(1)).alias("found"), F.countDistinct("requirement_id").alias("requirements"), F.min("p.match").alias("first_match"))


PLACEHOLDER_SQL = f"with {REQUIREMENTS_SQL}, p as (" + " union all ".join(
    f"select project_id, requirement_id, '{k}' as kind, {k != 'DRAFT'} as critical, unnest(regexp_extract_all(coalesce(draft_answer, ''), {quoted(p)}, 0{', ' + quoted('i') if a else ''})) as m from requirements" for k, p, a in R.PLACEHOLDERS
) + ") select project_id, kind, critical, count(*) as found, count(distinct requirement_id) as requirements, min(m) as first_match from p group by all"


def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requirements(spark, sf_dir).select("requirement_id", R.deadline_text(F.col("text")).alias("stated"), R.deadline(F.col("text")).alias("deadline")).where("stated is not null or deadline is not null")


_DATES = ("%B %d %Y", "%m/%d/%Y", "%Y-%m-%d", "%B %d %Y")
DEADLINE_SQL = f"""with {REQUIREMENTS_SQL}, d as (select requirement_id, nullif(regexp_extract(text, {quoted(R.DEADLINE_SIMPLE)}, 1, 'i'), '') as stated, coalesce(""" + ", ".join(
    f"strftime(try_strptime(regexp_replace(replace(nullif(regexp_extract(text, {quoted(p)}, 1, 'i'), ''), ',', ' '), '\\s+', ' ', 'g'), '{f}'), '%Y-%m-%d')" for (p, _), f in zip(R.DEADLINES, _DATES, strict=True)
) + ") as deadline from requirements) select * from d where stated is not null or deadline is not null"


def draft_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cleaning step of a draft on its own, and the steps in their order."""
    d = F.col("draft_answer")
    reqs = requirements(spark, sf_dir).join(projects(spark, sf_dir).select("project_id", "company_name"), "project_id", "left").where("draft_answer is not null")
    reqs = reqs.withColumn("no_fluff", let(N.without_fluff(d), lambda x: x))
    whole = N.tidy_breaks(N.without_tables(N.by_domain(N.guarded(F.col("no_fluff")), F.col("domain_context"))))
    return reqs.select(
        "requirement_id", "no_fluff", N.guarded(d).alias("guarded"), N.by_domain(d, F.col("domain_context")).alias("by_domain"), N.without_tables(d).alias("no_tables"), N.tidy_breaks(d).alias("tidy"), whole.alias("whole"), N.with_company(d, F.col("company_name")).alias("named")
    )


def _fluff(x: str) -> str:
    return strip_sql(replaced_sql(replaced_sql(replaced_sql(replaced_sql(x, N.FLUFF), N.ONE_SPACE, ""), N.LINE_ENDS, "m"), N.TWO_BREAKS, ""))


def _guarded(x: str) -> str:
    return replaced_sql(replaced_sql(x, N.OVERCLAIMS), N.ONE_SPACE, "")


def _by_domain(x: str) -> str:
    cases = []
    for name, terms in N.FORBIDDEN.items():
        done = replaced_sql(x, tuple((rf"\b{t}\b", "[REVIEW: term removed]" if name == "LEGAL" else "") for t in terms))
        if name in N.NOTICES:
            has = f"contains({done}, {quoted(N.NOTICES[name])}) or contains({done}, '[DRAFT]')" + (f" or contains({done}, 'may vary')" if name == "PROCESS" else "")
            done = f"case when {has} then {done} else {strip_sql(done)} || chr(10) || chr(10) || {quoted(N.NOTICES[name])} end"
        cases.append(f"when '{name}' then {done}")
    return strip_sql(replaced_sql(replaced_sql(f"(case domain_context {' '.join(cases)} else {x} end)", N.ONE_SPACE, ""), N.TWO_BREAKS, ""))


def _no_tables(x: str) -> str:
    cells = "list_filter(list_transform(string_split(regexp_extract(l, '^\\|(.+)\\|$', 1), '|'), lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), lambda c: c <> '')"
    bullet = f"case when not regexp_matches(l, '^\\|.+\\|$') then l when len({cells}) = 0 then '' when len({cells}) = 2 then '• ' || array_to_string({cells}, ': ') else '• ' || array_to_string({cells}, ' - ') end"
    lines = f"array_to_string(list_transform(string_split({replaced_sql(x, N.TABLE_RULES, 'm')}, chr(10)), lambda l: {bullet}), chr(10))"
    return replaced_sql(replaced_sql(lines, N.STRAY_PIPES, "m"), N.TWO_BREAKS, "")


def _tidy(x: str) -> str:
    return strip_sql(replaced_sql(replaced_sql(replaced_sql(x, N.BULLET_BREAKS, ""), N.TWO_BREAKS, ""), ((r"[ \t]+$", ""),), "m"))


CLEANUP_SQL = f"""with {REQUIREMENTS_SQL}, {PROJECTS_SQL}, a as (select r.*, p.company_name, draft_answer as d from requirements r left join projects p using (project_id) where draft_answer is not null),
b as (select *, {_fluff('d')} as no_fluff from a), c as (select *, {_guarded('no_fluff')} as w1 from b), e as (select *, {_by_domain('w1')} as w2 from c), f as (select *, {_no_tables('w2')} as w3 from e)
select requirement_id, no_fluff, {_guarded('d')} as guarded, {_by_domain('d')} as by_domain, {_no_tables('d')} as no_tables, {_tidy('d')} as tidy, {_tidy('w3')} as whole,
  case when coalesce(company_name, '') = '' then d else regexp_replace(d, '\\[\\s*company\\s+name\\s*\\]', company_name, 'gi') end as named from f"""


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, hashes and ids of all documents."""
    t = F.col("text")
    ids = N.section_ids(t)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).cast("long").alias("words"),
        F.size(F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: F.length(w) > 2))).cast("long").alias("long_words"),
        F.ceil(F.length(t) / 4).cast("long").alias("token_estimate"),
        F.left(F.sha2(F.concat(F.lit("v1:"), t), 256), F.lit(16)).alias("content_hash"),
        F.array_join(F.array_sort(ids), ",").alias("section_ids"),
        F.array_join(N.requirement_ids(t), ",").alias("requirement_ids"),
        (F.size(F.array_distinct(N.requirement_ids(t))) + F.floor(F.regexp_count(t, F.lit(r"\?")) / 3)).cast("long").alias("estimate"),
        N.section_header(t).alias("header"),
    )


_IDS = r"\b(\d+\.\d+\.\d+|[A-Z]\.\d+\.\d+)\b"
MEASURES_SQL = f"""with d as (select doc_id, text, regexp_extract_all(text, '{_IDS}', 1) as r, list_sort(list_distinct(flatten([{', '.join(f"regexp_extract_all(text, {quoted(p)}, 1)" for p in N.SECTION_IDS)}]))) as s, {strip_sql('text')} as t,
  regexp_split_to_array({strip_sql('text')}, '\\s+') as w from documents)
select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as words, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2))) as long_words,
  ceil(length(text) / 4.0)::bigint as token_estimate, left(sha256('v1:' || text), 16) as content_hash, array_to_string(s, ',') as section_ids, array_to_string(r, ',') as requirement_ids,
  (len(list_distinct(r)) + (length(text) - length(replace(text, '?', ''))) // 3)::bigint as estimate,
  length(t) <= 100 and not contains(t, '?') and (len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) * 2 > len(w) or suffix(t, ':')) and not regexp_matches(t, '^(Does|Do|Can|Will|Should|Must|Is|Are|Has|Have|Describe|Explain|Provide)', 'i') as header
from d"""


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glued requirements as rows of their own; headings become context rows."""
    rows = requirements(spark, sf_dir).select("requirement_id", "type", F.posexplode(N.split_requirements(F.col("text"))).alias("part", "p"))
    text = N.list_breaks(F.col("p.text"))
    return rows.select("requirement_id", "part", F.col("p.section").alias("section"), text.alias("text"), F.when(N.section_header(text), "CONTEXTUAL").otherwise(F.col("type")).alias("type"))


def tender_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tender text for each project: numbered requirements under section headings."""
    rows = requirements(spark, sf_dir).withColumn("line", F.concat_ws(" ", F.concat(F.lit("3."), (F.col("ord") % 4 + 1).cast("string"), F.lit("."), F.col("ord").cast("string")), "text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    head = F.lit("TENDER\n1.0 Introduction\n\nSection 2: Scope of Work\n3.1 Design, Form, and Templates\n3.\n1.\n17 Split number\n* starred\n- Dashed item\n– dashed\n○ round\n1.First\na)letter\n(iv) roman\nRef  Requirement  Answer\n5 SPECIAL CONDITIONS\n")
    # Dealt by a stated number, which adaptive execution keeps: what follows costs far more for each byte than a shuffle's size tells.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "project_id")
    return rows.groupBy("project_id").agg(F.concat(head, F.array_join(lines, "\n")).alias("text"))


#: How a tender numbers its requirements, by residue of its project: one form for each family.
NUMBERINGS = ("3.{k}.{i}", "II.A.{i}", "B.{k}.{i}", "C{i}.", "({i})", "{l}.", "[REQ-{i}]")
SECTION_HEADS = ("SPECIAL CONDITIONS", "Scope of Work", "Company Profile", "Security Needs", "DELIVERY AND TERMS")


def varied_tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tender texts in seven numbering families. Each fiftieth one is long, and half of the long ones have section heads."""
    project, long = F.col("project_id"), F.col("project_id") % 50 == 7
    headed = ~long | (F.floor(project / 50) % 2 == 0)
    rows = requirements(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "project_id")
    lists = rows.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts"))
    style = F.get(F.array(*map(F.lit, NUMBERINGS)), (project % len(NUMBERINGS)).cast("int"))

    def line(said: Column, i: Column) -> Column:
        number = F.replace(F.replace(F.replace(style, F.lit("{k}"), (i % 4 + 1).cast("string")), F.lit("{i}"), (i + 1).cast("string")), F.lit("{l}"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (i % 26 + 1).cast("int"), 1))
        head = F.concat(F.lit("\n"), F.floor(i / 3 + 4).cast("string"), F.lit(".0 "), F.get(F.array(*map(F.lit, SECTION_HEADS)), (F.floor(i / 3) % len(SECTION_HEADS)).cast("int")), F.lit("\n"))
        filler = F.when(long, F.repeat(F.lit(" The authority explains the background at length and asks for nothing here."), 100)).otherwise("")
        return F.concat(F.when(headed & (i % 3 == 0), head).otherwise(""), number, F.lit(" "), said, filler)

    return lists.select("project_id", F.concat(F.lit("TENDER\n"), F.array_join(F.transform("texts", line), "\n")).alias("text"))


def normalised_tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return tender_documents(spark, sf_dir).select("project_id", N.preprocess(t).alias("normalised"), N.preprocess(t, markers=False, tables=False).alias("plain"), N.for_model(t).alias("for_model"))


QUERIES = {
    "obligation_labels": (obligation_labels, OBLIGATION_SQL),
    "domain_labels": (domain_labels, DOMAIN_SQL),
    "attestation_labels": (attestation_labels, ATTESTATION_SQL),
    "type_labels": (type_labels, TYPE_SQL),
    "review_flags": (review_flags, REVIEW_ALL_SQL),
    "review_flags_checked": (review_flags_checked, REVIEW_SQL),
    "template_matches": (template_matches, TEMPLATE_SQL),
    "placeholder_scan": (placeholder_scan, PLACEHOLDER_SQL),
    "deadlines": (deadlines, DEADLINE_SQL),
    "draft_cleanup": (draft_cleanup, CLEANUP_SQL),
    "text_measures": (text_measures, MEASURES_SQL),
    "split_rows": (split_rows, None),
    "normalised_tenders": (normalised_tenders, None),
}


#: Words of types for the keyword score; the operator takes any such table.
KEYWORDS = {
    "QUANTITATIVE": (("price", "pricing", "cost", "fee", "rate", "budget", "sla", "uptime", "per-user"), ("number", "count", "minimum")),
    "EVIDENCE_BASED": (("certificate", "compliance", "audit", "gdpr", "insurance", "license", "iso-27001"), ("security", "proof", "documentation")),
    "PROCEDURAL": (("workflow", "process", "implementation", "migration", "support", "backup", "submit"), ("plan", "timeline", "phase")),
}


def answer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answer_kind(requirements(spark, sf_dir).select("requirement_id", "text", "section"), "text", "section", KEYWORDS)
    band = F.when(F.col("kind_confidence") >= 85, "high").when(F.col("kind_confidence") >= 70, "good").when(F.col("kind_confidence") >= 55, "fair").otherwise("low")
    return out.select("requirement_id", F.col("structure.kind").alias("structure"), F.col("structure.indicator").alias("indicator"), "kind", F.col("kind_confidence").alias("confidence"), band.alias("band"))


def keyword_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword scores of all documents and the best type."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = keyword_scores(F.col("text"), KEYWORDS)
    out = docs.select("doc_id", scores.alias("s"), F.coalesce(best_keywords(F.col("text"), KEYWORDS)["kind"], F.lit("")).alias("best"))
    return out.select("doc_id", *[F.get("s", i)["score"].alias(k.lower()) for i, k in enumerate(KEYWORDS)], "best")


def _score_sql(strong: tuple, weak: tuple) -> str:
    count = lambda ws: " + ".join("(" + " or ".join(f"contains(t, {quoted(v)})" for v in dict.fromkeys((w, w.replace("-", " "), w.replace("-", "")))) + ")::int" for w in ws)
    return f"(case when n > 0 then floor(least(100.0, (({count(strong)}) * 3 + {count(weak)}) / 15.0::double * 100) + 0.5) else 0 end)::int"


DENSITY_SQL = f"""with d as (select doc_id, lower(text) as t, len(list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda w: length(w) > 2)) as n from documents),
s as (select doc_id, {', '.join(f'{_score_sql(*w)} as {k.lower()}' for k, w in KEYWORDS.items())} from d)
select *, case when greatest({', '.join(k.lower() for k in KEYWORDS)}) < 15 then '' {' '.join(f"when {k.lower()} = greatest({', '.join(x.lower() for x in KEYWORDS)}) then '{k}'" for k in KEYWORDS)} end as best from s"""
QUERIES |= {"answer_kinds": (answer_kinds, None), "keyword_density": (keyword_density, DENSITY_SQL)}
