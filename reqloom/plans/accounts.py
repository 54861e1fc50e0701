"""Queries of accounts, reports and whole extraction runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.operators import accounts as A
from reqloom.operators import extraction as X
from reqloom.operators import keyed_time as T
from reqloom.operators import profile as P
from reqloom.operators import relational as J
from reqloom.operators import scoring
from reqloom.plans import matrix as M
from reqloom.plans.corpus import criteria, projects, requirements
from reqloom.plans.extracts import tenders
from reqloom.session import written

NOW = "2024-01-20 00:00:00"
PLANS = tuple(A.PLAN_LIMITS)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account for each customer; uses are the events of its last reset's month."""
    key = F.col("c_custkey")
    day = lambda n, m: F.when(key % 6 != 0, F.to_timestamp(F.lit(NOW)) + F.make_dt_interval(((key * n) % m - m // 2).cast("int")))
    plan = F.get(F.array(*map(F.lit, (*PLANS, "OTHER"))), (key % (len(PLANS) + 1)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        key.alias("user_id"), plan.alias("plan"), F.when(key % 4 == 1, F.concat(F.lit("sub_"), key.cast("string"))).alias("subscription"), day(7, 90).alias("period_end"), day(5, 60).alias("credits_until"),
        (key % 3).alias("extractions"), (key % 5).alias("drafts"), (key % 13).alias("used"), F.coalesce(day(3, 80), F.to_timestamp(F.lit(NOW))).alias("last_reset"),
    )


def _day(n: int, m: int) -> str:
    return f"case when c_custkey % 6 <> 0 then timestamp '{NOW}' + to_days(((c_custkey * {n}) % {m} - {m // 2})::int) end"


ACCOUNTS_SQL = f"""accounts as (select c_custkey as user_id, ({[*PLANS, 'OTHER']})[(c_custkey % {len(PLANS) + 1})::int + 1] as plan, case when c_custkey % 4 = 1 then 'sub_' || c_custkey end as subscription,
  {_day(7, 90)} as period_end, {_day(5, 60)} as credits_until, c_custkey % 3 as extractions, c_custkey % 5 as drafts, c_custkey % 13 as used, coalesce({_day(3, 80)}, timestamp '{NOW}') as last_reset from customer)"""
EXPIRED_SQL = f"plan in {A.GRANTABLE} and subscription is null and coalesce(period_end < timestamp '{NOW}', false)"


def plan_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective plan, limit and what remains of each account."""
    plans = spark.createDataFrame(list(A.PLAN_LIMITS.items()), "plan string, limit long")
    out = A.with_quota(accounts(spark, sf_dir), plans, F.to_timestamp(F.lit(NOW)))
    return out.select("user_id", "effective_plan", "limit", "used", "remaining", "allowed")


QUOTA_SQL = f"""with {ACCOUNTS_SQL}, plans as (select * from (values {', '.join(f"('{p}', {n})" for p, n in A.PLAN_LIMITS.items())}) as t(effective_plan, "limit")),
e as (select user_id, case when {EXPIRED_SQL} then 'FREE' else plan end as effective_plan, case when date_trunc('month', last_reset) <> date_trunc('month', timestamp '{NOW}') then 0 else used end as used from accounts),
q as (select user_id, effective_plan, coalesce("limit", 0)::bigint as "limit", used from e left join plans using (effective_plan))
select *, (case when "limit" = -1 then -1 else greatest(0, "limit" - used) end)::bigint as remaining, "limit" = -1 or used < "limit" as allowed from q"""


def expired_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts whose single-use credits are reset, or whose granted plan ends."""
    now = F.to_timestamp(F.lit(NOW))
    reset = A.credits_expired(F.col("credits_until"), F.col("extractions"), F.col("drafts"), now)
    ends = A.grant_expired(F.col("plan"), F.col("subscription"), F.col("period_end"), now)
    return accounts(spark, sf_dir).select("user_id", reset.alias("credits_reset"), ends.alias("downgraded"), A.referred(F.col("subscription")).alias("subscribed")).where("credits_reset or downgraded")


EXPIRED_ACCOUNTS_SQL = f"""with {ACCOUNTS_SQL}, a as (select user_id, coalesce(credits_until < timestamp '{NOW}', false) and (extractions > 0 or drafts > 0) as credits_reset, {EXPIRED_SQL} as downgraded, subscription is not null as subscribed from accounts)
select * from a where credits_reset or downgraded"""


def weight_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sizes of a brand's parts sum up to about a hundred, as weights of criteria must."""
    return A.valid_weights(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws("/", "p_brand", "p_type").alias("brand"), "p_size"), "brand", "p_size")


WEIGHT_SQL = f"select concat_ws('/', p_brand, p_type) as brand, sum(p_size)::bigint as total, sum(p_size) between {A.LEAST_WEIGHT} and {A.MOST_WEIGHT} as valid from part group by 1"


def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the ids made from names have the shape of record ids."""
    id_ = F.concat(F.lit("c"), F.substring(F.sha2("c_name", 256), 1, 23), F.when(F.col("c_custkey") % 3 == 0, F.lit("X")).otherwise(F.lit("7")), F.when(F.col("c_custkey") % 7 == 0, F.lit("\n")).otherwise(F.lit("")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", A.valid_id(id_).alias("valid"))


IDS_SQL = r"""select c_custkey, regexp_full_match('c' || left(sha256(c_name), 23) || case when c_custkey % 3 = 0 then 'X' else '7' end || case when c_custkey % 7 = 0 then chr(10) else '' end, 'c[a-z0-9]{24}') as valid from customer"""


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by side of the dashboard; each third one is past its deadline."""
    done = scoring.progress(requirements(spark, sf_dir)).select("project_id", "overall")
    rows = projects(spark, sf_dir).join(done, "project_id", "left")
    past = F.when(F.col("project_id") % 5 != 0, F.col("project_id") % 3 == 0)
    return rows.select("project_id", A.dashboard_side(F.coalesce("overall", F.lit(0)), past, F.col("status")).alias("side"))


DASHBOARD_SQL = f"""with p as (select c_custkey as project_id, (['READY', 'PROCESSING', 'COMPLETED', 'FAILED'])[(c_custkey % 4)::int + 1] as status from customer), d as ({M.QUERIES["progress"][1]})
select project_id, case when status in ('PROCESSING', 'FAILED') then 'active' when coalesce(overall, 0) >= 100 or (project_id % 5 <> 0 and project_id % 3 = 0) then 'completed' else 'active' end as side from p left join d using (project_id)"""


def project_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enhanced summary of each project."""
    return A.report(requirements(spark, sf_dir), criteria(spark), M.QUERIES["readiness"][0](spark, sf_dir))


REPORT_SQL = f"""with o as ({M.QUERIES["criteria_overall"][1]}), d as ({M.QUERIES["progress"][1]}), r as (select project_id, bool_and(ready) as ready, count(*) as issues from ({M.QUERIES["readiness"][1]}) group by project_id),
i as (select project_id, count(*) as insights from ({M.QUERIES["insights"][1]}) group by project_id), f as (select project_id, sum(impact)::bigint as potential, max(requirement_id) filter (rank = 1) as first_focus from ({M.QUERIES["focus_items"][1]}) group by project_id)
select o.project_id, o.overall as criteria_score, d.mandatory, d.completion, coalesce(ready, true) as ready, coalesce(issues, 0)::bigint as issues, coalesce(insights, 0)::bigint as insights, coalesce(potential, 0)::bigint as potential, first_focus
from o left join d using (project_id) left join r using (project_id) left join i using (project_id) left join f using (project_id)"""


def login_lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a user: more than two within two days of the first lock for three."""
    return T.lockouts(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id", 2, 172_800, 259_200)


def number_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.number_changes(tenders(spark, sf_dir).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for a summary of each tender, and the text under two prefixes."""
    docs = tenders(spark, sf_dir)
    under = docs.select("doc_id", P.prefix_sections(F.col("text"), ["3.1", "3.2"]).alias("under"))
    return P.section_summary(X.detected_sections(docs)).join(under, "doc_id")


def extraction_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run for each tender: candidates of the scan, those left after near-dedup, the numbers stated in the text, and how many of these no row covers."""
    docs = written(tenders(spark, sf_dir), "tenders")
    rows = written(X.all_candidates(docs).select("doc_id", "label", "text", F.xxhash64("doc_id", "start", "label").alias("row")), "candidates")
    kept = J.keep_first_unlike(rows, "doc_id", "row", "text")
    stated = written(docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\d.])(\d+\.\d+\.\d+)(?![\d.])"), F.lit(1)))).alias("section")), "stated")
    missing = J.uncovered_sections(stated, kept.select("doc_id", F.col("label").alias("section")), "doc_id")
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    out = docs.select("doc_id")
    for part, name in ((rows, "candidates"), (kept, "kept"), (stated, "stated"), (missing, "missing")):
        out = out.join(count(part, name), "doc_id", "left")
    return out.na.fill(0)


QUERIES = {
    "plan_quota": (plan_quota, QUOTA_SQL),
    "expired_accounts": (expired_accounts, EXPIRED_ACCOUNTS_SQL),
    "weight_checks": (weight_checks, WEIGHT_SQL),
    "record_ids": (record_ids, IDS_SQL),
    "dashboard": (dashboard, DASHBOARD_SQL),
    "project_report": (project_report, REPORT_SQL),
    "login_lockouts": (login_lockouts, None),
    "number_chunks": (number_chunks, None),
    "section_summaries": (section_summaries, None),
    "extraction_runs": (extraction_runs, None),
}
