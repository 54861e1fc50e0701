"""Queries of joins, sets, pages, history and keyed time, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions import text as N
from reqloom.functions.sections import major_category
from reqloom.operators import keyed_time as T
from reqloom.operators import relational as J
from reqloom.operators.scoring import shortened
from reqloom.plans.corpus import PROJECTS_SQL, REQUIREMENTS_SQL, projects, requirements
from reqloom.plans.matrix import category_sql


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects with their requirements nested in order, and how many they are."""
    rows = requirements(spark, sf_dir).select("project_id", "ord", "status")
    out = J.nested(projects(spark, sf_dir), rows, "project_id", "ord", "rows")
    return out.select("project_id", "name", F.size("rows").cast("long").alias("n"), F.to_json("rows").alias("rows"))


NESTED_SQL = f"""with {REQUIREMENTS_SQL}, {PROJECTS_SQL} select p.project_id, p.name, count(r.ord) as n,
  '[' || coalesce(string_agg('{{"ord":' || r.ord || ',"status":"' || r.status || '"}}', ',' order by r.ord), '') || ']' as rows from projects p left join requirements r using (project_id) group by 1, 2"""


def owned_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level security over two hops: requirements whose project belongs to a user of region 1."""
    users = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("user_id"))
    mine = projects(spark, sf_dir).join(users, "user_id", "left_semi").select("project_id")
    return requirements(spark, sf_dir).join(mine, "project_id", "left_semi").select("requirement_id", "project_id", "status")


OWNED_SQL = f"""with {REQUIREMENTS_SQL}, {PROJECTS_SQL} select requirement_id, project_id, status from requirements r where exists (select 1 from projects p where p.project_id = r.project_id
  and exists (select 1 from nation n where n.n_nationkey = p.user_id and n.n_regionkey = 1))"""


def referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referrers (a customer refers those with ten times its key and up to nine more) with counts, most first, and the overall rate."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.floor(F.col("c_custkey") / 10).cast("long").alias("referred_by"), (F.col("c_acctbal") > 0).alias("paid"))
    per = users.where("referred_by > 0").groupBy("referred_by").agg(F.count(F.lit(1)).alias("referred"), F.count_if("paid").alias("converted"))
    out = users.select("user_id").join(per, F.col("user_id") == F.col("referred_by"))
    rate = F.when(F.col("referred") > 0, F.floor(F.col("converted") / F.col("referred") * 100 + 0.5)).otherwise(0).cast("long")
    return out.select("user_id", "referred", "converted", rate.alias("rate"))


REFERRAL_SQL = """with u as (select c_custkey as user_id, c_custkey // 10 as referred_by, c_acctbal > 0 as paid from customer),
p as (select referred_by, count(*) as referred, count(*) filter (paid) as converted from u where referred_by > 0 group by 1)
select user_id, referred, converted, floor(converted::double / referred * 100 + 0.5)::bigint as rate from u join p on u.user_id = p.referred_by"""


def top_referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of referrers by count."""
    return J.page(referrals(spark, sf_dir), [F.desc("referred"), F.desc("converted"), "user_id"], 10, 5)


TOP_REFERRER_SQL = f"select * from ({REFERRAL_SQL}) order by referred desc, converted desc, user_id limit 10 offset 5"


def library_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in documents, newest first, one page, long texts cut."""
    found = J.text_search(table(spark, sf_dir, "documents"), "THE", "text", "source").where(F.col("lang").isin("en", "fr"))
    return J.page(found.select("doc_id", "lang", shortened(F.col("text"), 300).alias("text")), [F.desc("doc_id")], 500, 20)


LIBRARY_SQL = """select doc_id, lang, case when length(text) > 300 then substr(text, 1, 300) || '...' else text end as text from documents
where (contains(lower(text), 'the') or contains(lower(source), 'the')) and lang in ('en', 'fr') order by doc_id desc limit 100 offset 20"""


def tag_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts use each cleaned tag, of the parts whose key is no multiple of three; tag_counts is over all parts."""
    raw = F.split(F.concat_ws("|", "p_brand", F.concat(F.lit(" "), "p_type", F.lit(" ")), F.lit(""), "p_brand", "p_name"), r"\|")
    tagged = table(spark, sf_dir, "part").select("p_partkey", J.clean_tags(raw).alias("tags")).where("p_partkey % 3 <> 0")
    return tagged.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("used"))


TAG_SQL = """with t as (select list_distinct(list_slice(list_filter(list_transform(string_split(concat_ws('|', p_brand, ' ' || p_type || ' ', '', p_brand, p_name), '|'), lambda x: lower(trim(x))), lambda x: length(x) between 1 and 50), 1, 20)) as tags
  from part where p_partkey % 3 <> 0) select tag, count(*) as used from (select unnest(tags) as tag from t) group by tag"""


def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.split(F.concat_ws("|", "p_brand", F.concat(F.lit(" "), "p_type", F.lit(" ")), F.lit(""), "p_brand", "p_name"), r"\|")
    return table(spark, sf_dir, "part").select("p_partkey", J.clean_tags(raw).alias("tags"))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts use each cleaned tag, over all parts."""
    return part_tags(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("used"))


PART_TAGS_SQL = """with t as (select p_partkey, list_distinct(list_slice(list_filter(list_transform(string_split(concat_ws('|', p_brand, ' ' || p_type || ' ', '', p_brand, p_name), '|'), lambda x: lower(trim(x))), lambda x: length(x) between 1 and 50), 1, 20)) as tags from part)"""
TAG_COUNT_SQL = f"{PART_TAGS_SQL} select tag, count(*) as used from (select unnest(tags) as tag from t) group by tag"


def tagged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that carry one of two tags."""
    return part_tags(spark, sf_dir).where(J.has_any(F.col("tags"), ["Brand#12", " Brand#23 "])).select("p_partkey", F.size("tags").cast("long").alias("n"))


TAGGED_SQL = f"{PART_TAGS_SQL} select p_partkey, len(tags)::bigint as n from t where list_has_any(tags, ['brand#12', 'brand#23'])"


def normalised_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each text, case and white space apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", J.text_key(F.col("text")).alias("key"))
    return docs.groupBy(F.sha2("key", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


DEDUP_SQL = "select sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as digest, min(doc_id) as doc_id, count(*) as copies from documents group by 1"


def section_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First requirement of each section, or of each beginning of a text, in a project; short and context rows left out."""
    rows = requirements(spark, sf_dir).where("type <> 'CONTEXTUAL' and length(text) > 10")
    key = F.coalesce(F.nullif(F.col("section"), F.lit("")), F.substring("text", 1, 100))
    return J.first_of_key(rows.withColumn("key", key), ["project_id", "key"], ["ord"]).select("project_id", "key", "requirement_id")


SECTION_DEDUP_SQL = f"""with {REQUIREMENTS_SQL} select project_id, coalesce(nullif(section, ''), substr(text, 1, 100)) as key, min(requirement_id) as requirement_id from requirements where type <> 'CONTEXTUAL' and length(text) > 10 group by 1, 2"""


def similar_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one project with nearly the same words."""
    rows = requirements(spark, sf_dir).withColumn("text", F.concat_ws(" ", "text", F.lit("within the agreed service period of this framework contract and its annexes one two three four"), (F.col("ord") % 3).cast("string")))
    return J.jaccard_pairs(rows, "project_id", "requirement_id", "text", 0.6)


SIMILAR_SQL = f"""with {REQUIREMENTS_SQL}, w as (select project_id, requirement_id, list_distinct(list_filter(regexp_split_to_array(lower(text || ' within the agreed service period of this framework contract and its annexes one two three four ' || (ord % 3)), '\\s+'), lambda x: length(x) > 2)) as ws from requirements),
p as (select a.project_id, a.requirement_id as a, b.requirement_id as b, len(list_intersect(a.ws, b.ws)) as i, len(a.ws) as n, len(b.ws) as m from w a join w b on a.project_id = b.project_id and a.requirement_id < b.requirement_id)
select project_id, a, b, i::double / (n + m - i) as similarity from p where i::double / (n + m - i) > 0.6"""


def unlike_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What greedy near-dedup keeps of each project."""
    rows = requirements(spark, sf_dir).select("project_id", "requirement_id", "text")
    return J.keep_first_unlike(rows, "project_id", "requirement_id", "text", 0.9).select("project_id", "requirement_id")


def uncovered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section numbers that documents state and no requirement label covers."""
    stated = table(spark, sf_dir, "documents").select("doc_id", F.explode(N.section_ids(F.col("text"))).alias("section"))
    held = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit("3.1"), F.concat((F.col("doc_id") % 9).cast("string"), F.lit(".2.1")))).alias("section"))
    return J.uncovered_sections(stated, held, "doc_id")


UNCOVERED_SQL = f"""with s as (select distinct doc_id, unnest(flatten([{', '.join(f"regexp_extract_all(text, '{p}', 1)" for p in N.SECTION_IDS)}])) as section from documents),
h as (select doc_id, unnest(['3.1', (doc_id % 9)::varchar || '.2.1']) as section from documents)
select doc_id, section from s where not exists (select 1 from h where h.doc_id = s.doc_id and (h.section = s.section or starts_with(h.section, s.section || '.') or starts_with(s.section, h.section || '.')))"""


def uncovered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events outside all intervals of their user (a minute around each purchase)."""
    e = events(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    spans = e.where("event_type = 'purchase'").select("user_id", (F.col("at") - 60_000_000).alias("start"), (F.col("at") + 60_000_000).alias("end"))
    return J.outside_intervals(e.where("event_type <> 'purchase'"), spans, "user_id").select("event_id", "user_id")


QUESTION_SQL = """with e as (select event_id, user_id, epoch_us(ts) as at, event_type from events)
select event_id, user_id from e where event_type <> 'purchase' and not exists (select 1 from e p where p.event_type = 'purchase' and p.user_id = e.user_id and e.at between p.at - 60000000 and p.at + 60000000)"""


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i-th refinement with i-th requirement of a project, as far as the shorter list goes; the others keep their type."""
    rows = requirements(spark, sf_dir).select("project_id", "requirement_id", "type", "ord")
    numbered = rows.withColumn("pos", F.row_number().over(Window.partitionBy("project_id").orderBy("ord")) - 1)
    refined = projects(spark, sf_dir).select("project_id", F.posexplode(F.array_repeat(F.lit("STAFFING"), (F.col("project_id") % 4).cast("int"))).alias("pos", "refined"))
    return numbered.join(refined, ["project_id", "pos"], "left").select("project_id", "requirement_id", "pos", F.coalesce("refined", "type").alias("type"))


ZIP_SQL = f"""with {REQUIREMENTS_SQL}, n as (select project_id, requirement_id, type, (row_number() over (partition by project_id order by ord) - 1)::int as pos from requirements)
select project_id, requirement_id, pos, case when pos < project_id % 4 then 'STAFFING' else type end as type from n"""


def expired_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders past a date fail; others keep their status (an update through a subquery)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    stale = orders.where("o_orderstatus = 'O' and o_orderdate < timestamp'1995-01-01'").select("o_orderkey", F.lit(True).alias("stale"))
    return orders.join(stale, "o_orderkey", "left").select("o_orderkey", F.when(F.col("stale"), "X").otherwise(F.col("o_orderstatus")).alias("status"))


EXPIRED_SQL = "select o_orderkey, case when o_orderkey in (select o_orderkey from orders where o_orderstatus = 'O' and o_orderdate < timestamp '1995-01-01') then 'X' else o_orderstatus end as status from orders"


def deadline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reminders: projects due from a day before to eight days after a date, with days left and what is sent."""
    now = F.to_timestamp(F.lit("1995-06-15 09:00:00"))
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate").between(now - F.expr("interval 1 day"), now + F.expr("interval 8 days")) & F.col("o_orderstatus").isin("O", "P"))
    days = T.days_until(F.col("o_orderdate"), now)
    last = F.get(F.array(F.lit(None), F.lit("7d"), F.lit("overdue"), F.lit("1d")), (F.col("o_orderkey") % 4).cast("int"))
    return orders.select("o_orderkey", days.alias("days"), F.coalesce(T.reminder(days, last), F.lit("")).alias("reminder"))


WINDOW_SQL = """with o as (select o_orderkey, date_diff('day', date '1995-06-15', o_orderdate::date)::int as days, ([null, '7d', 'overdue', '1d'])[(o_orderkey % 4)::int + 1] as last from orders
  where o_orderdate between timestamp '1995-06-14 09:00:00' and timestamp '1995-06-23 09:00:00' and o_orderstatus in ('O', 'P')),
d as (select *, case when days <= 0 then 'overdue' when days = 1 then '1d' when days = 3 then '3d' when days = 7 then '7d' end as due from o)
select o_orderkey, days, case when due is distinct from last then coalesce(due, '') else '' end as reminder from d"""


def json_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys the JSON details of each event have, and the first; events_by_detail compares a value."""
    keyed = events(spark, sf_dir).select("event_id", F.json_object_keys("props").alias("keys"), "props")
    first = F.get("keys", 0)
    return keyed.select("event_id", F.size("keys").cast("long").alias("n"), first.alias("first_key"))


JSON_SQL = "select event_id, len(json_keys(props))::bigint as n, json_keys(props)[1] as first_key from events"


def events_by_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a value inside their JSON details."""
    return events(spark, sf_dir).where(J.json_equals(F.col("props"), "$.k", "87")).select("event_id", "event_type")


DETAIL_SQL = "select event_id, event_type from events where json_extract_string(props, '$.k') = '87'"


def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sliding_limit(events(spark, sf_dir), "user_id", "ts", 86_400, 3).select("event_id", "user_id", "in_window", "allowed")


SLIDING_SQL = "select event_id, user_id, count(*) over w as in_window, count(*) over w <= 3 as allowed from events window w as (partition by user_id order by epoch_us(ts) range between 86399999999 preceding and current row)"


def fixed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fixed_limit(events(spark, sf_dir), "user_id", "ts", "event_id", 86_400, 3).select("user_id", "event_id", "in_window", "allowed")


#: The next window opens with the first event a day or more after the last opening.
FIXED_SQL = """with recursive o as (select user_id, min(ts) as opened from events group by user_id
  union all select user_id, next from (select o.user_id, (select min(e.ts) from events e where e.user_id = o.user_id and e.ts >= o.opened + interval 1 day) as next from o) n where next is not null)
select e.user_id, e.event_id, (row_number() over w)::int as in_window, row_number() over w <= 3 as allowed from events e asof join o on e.user_id = o.user_id and e.ts >= o.opened window w as (partition by e.user_id, o.opened order by e.ts, e.event_id)"""


def idempotent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (user, type) event once, at its first time."""
    e = events(spark, sf_dir).withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return T.first_seen(e, "key", "ts", "event_id").select("key", "event_id")


IDEMPOTENT_SQL = "select user_id || ':' || event_type as key, arg_min(event_id, (ts, event_id)) as event_id from events group by 1"


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs (by user and day) from start and completion events; without a completion they time out after an hour."""
    state = F.when(F.col("event_id") % 5 == 0, "COMPLETE").when(F.col("event_id") % 7 == 0, "FAILED").otherwise("PROCESSING")
    e = events(spark, sf_dir).select("event_id", "ts", state.alias("state"), F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("job"))
    out = T.final_states(e, "job", "ts", "state", "event_id", 3600, F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    return out.select("job", "state", "completions")


JOB_SQL = """with e as (select event_id, ts, user_id || '-' || strftime(ts, '%Y%m%d') as job, case when event_id % 5 = 0 then 'COMPLETE' when event_id % 7 = 0 then 'FAILED' else 'PROCESSING' end as state from events)
select job, coalesce(arg_min(state, (ts, event_id)) filter (state <> 'PROCESSING'), case when epoch_us(timestamp '2024-01-20 00:00:00') - epoch_us(min(ts)) > 3600000000 then 'FAILED' else 'PROCESSING' end) as state,
  count(*) filter (state <> 'PROCESSING') as completions from e group by job"""


def monthly_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.monthly_use(events(spark, sf_dir), "user_id", "ts", "event_id", 20).select("event_id", "month", "used", "allowed")


MONTHLY_SQL = "select event_id, strftime(ts, '%Y-%m') as month, count(*) over w as used, count(*) over w <= 20 as allowed from events window w as (partition by user_id, strftime(ts, '%Y-%m') order by ts, event_id rows between unbounded preceding and current row)"


def credit_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.consume_credits(events(spark, sf_dir), "user_id", "ts", "event_id", 10, F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("event_id", "left", "allowed")


CREDIT_SQL = """with u as (select event_id, ts <= timestamp '2024-01-20 00:00:00' as valid, sum((ts <= timestamp '2024-01-20 00:00:00')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as used from events)
select event_id, greatest(0, 10 - used)::bigint as left, valid and used <= 10 as allowed from u"""


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Former types of each user's events at each change."""
    return J.change_history(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "former", "version")


HISTORY_SQL = """with l as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as former from events)
select user_id, event_id, former, (row_number() over (partition by user_id order by ts desc, event_id desc))::int as version from l where former is not null and former <> event_type"""


def go_no_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mandatory = F.when(k % 9 == 0, -100).otherwise(20)
    score, said = T.go_no_go(F.array(mandatory, (k % 26).cast("int"), (k % 21).cast("int"), (k % 16).cast("int"), (k % 23).cast("int")), mandatory)
    return table(spark, sf_dir, "customer").select("c_custkey", score.alias("score"), said.alias("said"))


GO_SQL = """with a as (select c_custkey, case when c_custkey % 9 = 0 then -100 else 20 end as m, (c_custkey % 26 + c_custkey % 21 + c_custkey % 16 + c_custkey % 23)::int as rest from customer),
s as (select c_custkey, m, greatest(0, least(100, m + rest))::int as score from a)
select c_custkey, score, case when m = -100 then 'NO-GO: mandatory gap' when score >= 75 then 'STRONG GO' when score >= 50 then 'CONDITIONAL GO' when score >= 25 then 'LIKELY NO-GO' else 'NO-GO' end as said from s"""


def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories in order: numbers first by value, then the others by code point."""
    keyed = requirements(spark, sf_dir).select(major_category(F.col("section")).alias("category")).distinct()
    number = F.regexp_extract("category", "^([0-9]+)$", 1).try_cast("int")
    place = F.row_number().over(Window.orderBy(number.isNull(), number, "category"))  # one row a category: few
    return keyed.select("category", place.alias("place"))


INDEX_SQL = f"""with {REQUIREMENTS_SQL}, k as (select distinct {category_sql('section')} as category from requirements)
select category, (row_number() over (order by try_cast(category as int) is null, try_cast(category as int), category))::int as place from k"""


QUERIES = {
    "project_requirements": (project_requirements, NESTED_SQL),
    "owned_requirements": (owned_requirements, OWNED_SQL),
    "referrals": (referrals, REFERRAL_SQL),
    "top_referrers": (top_referrers, TOP_REFERRER_SQL),
    "library_page": (library_page, LIBRARY_SQL),
    "tag_list": (tag_list, TAG_SQL),
    "tag_counts": (tag_counts, TAG_COUNT_SQL),
    "tagged_parts": (tagged_parts, TAGGED_SQL),
    "normalised_dedup": (normalised_dedup, DEDUP_SQL),
    "section_dedup": (section_dedup, SECTION_DEDUP_SQL),
    "similar_requirements": (similar_requirements, SIMILAR_SQL),
    "unlike_requirements": (unlike_requirements, None),
    "uncovered_sections": (uncovered_sections, UNCOVERED_SQL),
    "uncovered_questions": (uncovered_questions, QUESTION_SQL),
    "positional_zip": (positional_zip, ZIP_SQL),
    "expired_update": (expired_update, EXPIRED_SQL),
    "deadline_window": (deadline_window, WINDOW_SQL),
    "json_details": (json_details, JSON_SQL),
    "events_by_detail": (events_by_detail, DETAIL_SQL),
    "sliding_rate": (sliding_rate, SLIDING_SQL),
    "fixed_rate": (fixed_rate, FIXED_SQL),
    "idempotent_events": (idempotent_events, IDEMPOTENT_SQL),
    "job_states": (job_states, JOB_SQL),
    "monthly_quota": (monthly_quota, MONTHLY_SQL),
    "credit_use": (credit_use, CREDIT_SQL),
    "version_history": (version_history, HISTORY_SQL),
    "go_no_go": (go_no_go, GO_SQL),
    "category_index": (category_index, INDEX_SQL),
}
