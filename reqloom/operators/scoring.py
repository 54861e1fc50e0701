"""Weighted completion scores, readiness, what-if impact and insights over requirement rows.

Weights are kept in tenths as whole numbers, so sums do not depend on the order of rows; a score is rounded half up.
Everything is keyed by project_id: one shuffle on it serves a whole report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqloom.functions.sections import category_title, major_category

#: Weight of the obligation and of the domain.
MANDATORY_WEIGHT = 2.0
DOMAIN_WEIGHTS = {"LEGAL": 1.5, "PROCESS": 1.2, "FEATURE": 1.0}
DOMAINS = ("FEATURE", "PROCESS", "LEGAL")
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
BANDS = ((80, "high"), (60, "medium"), (40, "low"))


def weight10() -> Column:
    """Weight of a requirement in tenths."""
    by_domain = F.lit(1.0)
    for domain, w in DOMAIN_WEIGHTS.items():
        by_domain = F.when(F.col("domain_context") == domain, w).otherwise(by_domain)
    return F.round(F.when(F.col("is_mandatory"), MANDATORY_WEIGHT).otherwise(1.0) * by_domain * 10).cast("long")


def contribution2() -> Column:
    """Twice what a status earns of its weight."""
    return F.when(F.col("status") == "ANSWERED", 2).when(F.col("status") == "PARTIAL", 1).otherwise(0).cast("long")


def percent(earned: Column, whole: Column, empty: int = 100) -> Column:
    """Rounded percentage; empty where there is nothing to earn."""
    return F.when(F.coalesce(whole, F.lit(0)) > 0, F.floor(earned / whole * 100 + 0.5)).otherwise(empty).cast("long")


def weighted_score() -> Column:
    """Aggregate: weighted completion of the group."""
    return percent(F.sum(weight10() * contribution2()), F.sum(weight10() * 2))


def mandatory_score() -> Column:
    done = F.sum(F.when(F.col("is_mandatory"), contribution2()))
    return percent(done, F.count_if(F.col("is_mandatory")) * 2)


def group_label() -> Column:
    """Section group, or else section; an empty text counts as none."""
    return F.coalesce(F.nullif(F.col("section_group"), F.lit("")), F.col("section"))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def band(score: Column) -> Column:
    out = F.lit("none")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def over_limit() -> Column:
    """Draft beyond its word or character limit; an empty draft never is."""
    draft = F.coalesce("draft_answer", F.lit(""))
    words = F.size(F.filter(F.split(draft, r"\s+"), lambda w: w != ""))
    over = F.coalesce(words > F.col("word_limit"), F.lit(False)) | F.coalesce(F.length(draft) > F.col("character_limit"), F.lit(False))
    return (draft != "") & over


def summary(reqs: DataFrame) -> DataFrame:
    """One row a project: counts by status, overall and mandatory score, grade and band."""
    out = reqs.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ANSWERED").alias("answered"),
        F.count_if(F.col("status") == "PARTIAL").alias("partial"),
        F.count_if(F.coalesce("status", F.lit("UNANSWERED")) == "UNANSWERED").alias("unanswered"),
        weighted_score().alias("overall"),
        mandatory_score().alias("mandatory"),
    )
    return out.withColumn("grade", grade(F.col("overall"))).withColumn("band", band(F.col("overall")))


def section_scores(reqs: DataFrame) -> DataFrame:
    keyed = reqs.withColumn("category", major_category(group_label()))
    return keyed.groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ANSWERED").alias("answered"), weighted_score().alias("score"))


def domain_scores(reqs: DataFrame) -> DataFrame:
    """One column for each domain; a domain without rows scores 100."""
    w, c = weight10(), contribution2()
    cells = [percent(F.sum(F.when(F.col("domain_context") == d, w * c)), F.sum(F.when(F.col("domain_context") == d, w * 2))).alias(d.lower()) for d in DOMAINS]
    return reqs.groupBy("project_id").agg(*cells)


RULES = (
    ("mandatory_unanswered", True, lambda: F.col("is_mandatory") & (F.col("status") == "UNANSWERED")),
    ("legal_unreviewed", True, lambda: (F.col("domain_context") == "LEGAL") & F.coalesce("requires_review", F.lit(False))),
    ("over_limit", True, over_limit),
    ("mandatory_partial", False, lambda: F.col("is_mandatory") & (F.col("status") == "PARTIAL")),
    ("needs_review", False, lambda: F.coalesce("requires_review", F.lit(False)) & (F.col("domain_context") != "LEGAL")),
)


def readiness(reqs: DataFrame, projects: DataFrame) -> DataFrame:
    """A row for each rule that a project breaks: rule, blocker, number and ids of its requirements, and whether the project is ready."""
    ids = [F.array_sort(F.collect_list(F.when(test(), F.col("requirement_id")))).alias(name) for name, _, test in RULES]
    facts = reqs.groupBy("project_id").agg(*ids, F.count_if(F.col("status") == "ANSWERED").alias("answered"), F.count(F.lit(1)).alias("total"))
    facts = facts.join(projects.select("project_id", "company_name"), "project_id", "left")
    rate = percent(F.col("answered"), F.col("total"))
    none = F.array().cast("array<bigint>")
    issue = lambda name, blocker, found, number, which: F.when(found, F.struct(F.lit(name).alias("rule"), F.lit(blocker).alias("blocker"), number.cast("long").alias("number"), which.alias("ids")))
    issues = [issue(name, blocker, F.size(name) > 0, F.size(name), F.col(name)) for name, blocker, _ in RULES]
    issues.append(issue("low_completion", False, rate < 80, rate, none))
    issues.append(issue("missing_company_name", False, F.coalesce("company_name", F.lit("")) == "", F.lit(0), none))
    ready = F.greatest(*[F.size(name) for name, blocker, _ in RULES if blocker]) == 0
    broken = facts.select("project_id", ready.alias("ready"), F.inline(F.array_compact(F.array(*issues))))
    return broken.select("project_id", "ready", "rule", "blocker", "number", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def linked(reqs: DataFrame, criteria: DataFrame) -> DataFrame:
    """Requirement rows by criterion; a section may belong to several."""
    sections = criteria.select("criterion_id", "name", "weight", F.explode("linked_sections").alias("category"))
    return reqs.withColumn("category", major_category(F.col("section"))).join(sections, "category")


def criterion_scores(reqs: DataFrame, criteria: DataFrame) -> DataFrame:
    """A row for each project and criterion, also without requirements."""
    scored = linked(reqs, criteria).groupBy("project_id", "criterion_id").agg(weighted_score().alias("score"), F.count(F.lit(1)).alias("requirements"), F.count_if(F.col("status") == "ANSWERED").alias("answered"))
    listed = criteria.agg(F.collect_list(F.struct("criterion_id", "name", "weight")).alias("criteria"))  # one row: a report's criteria are what its author lists
    frame = reqs.select("project_id").distinct().withColumn("criteria", listed.scalar()).select("project_id", F.inline("criteria"))
    out = frame.join(scored, ["project_id", "criterion_id"], "left")
    return out.select("project_id", "criterion_id", "name", "weight", F.coalesce("score", F.lit(100)).cast("long").alias("score"), F.coalesce("requirements", F.lit(0)).cast("long").alias("requirements"), F.coalesce("answered", F.lit(0)).cast("long").alias("answered"))


def unlinked(reqs: DataFrame, criteria: DataFrame) -> DataFrame:
    """Requirements in no criterion."""
    sections = criteria.select(F.explode("linked_sections").alias("category")).distinct()
    return reqs.withColumn("category", major_category(F.col("section"))).join(sections, "category", "left_anti")


def criteria_overall(reqs: DataFrame, criteria: DataFrame) -> DataFrame:
    """Weighted mean of the (rounded) criterion scores; rows in no criterion take the weight that is left of 100."""
    used = criterion_scores(reqs, criteria).where("requirements > 0").groupBy("project_id").agg(F.sum(F.col("score") * F.col("weight")).alias("earned"), F.sum("weight").alias("used"))
    rest = unlinked(reqs, criteria).groupBy("project_id").agg(weighted_score().alias("rest"))
    out = reqs.select("project_id").distinct().join(used, "project_id", "left").join(rest, "project_id", "left")
    out = out.withColumn("used", F.coalesce("used", F.lit(0))).withColumn("earned", F.coalesce("earned", F.lit(0)))
    takes_rest = F.col("rest").isNotNull() & (F.col("used") < 100)
    earned = F.col("earned") + F.when(takes_rest, F.col("rest") * (100 - F.col("used"))).otherwise(0)
    whole = F.when(takes_rest, 100).otherwise(F.col("used"))
    return out.select("project_id", F.when(whole > 0, F.floor(earned / whole + 0.5)).otherwise(100).cast("long").alias("overall"))


def with_impact(reqs: DataFrame) -> DataFrame:
    """Adds impact: by how much the project's score would rise if this row were answered. Window sums stand for a rescoring of each row."""
    project = Window.partitionBy("project_id")
    w, c = weight10(), contribution2()
    earned, whole = F.sum(w * c).over(project), F.sum(w * 2).over(project)
    now = F.floor(earned / whole * 100 + 0.5)
    then = F.floor((earned + w * (2 - c)) / whole * 100 + 0.5)
    return reqs.withColumn("impact", F.when(F.col("status") == "ANSWERED", 0).otherwise(F.greatest(F.lit(0), then - now)).cast("long"))


def reason(criteria_weights: Column | None = None) -> Column:
    """Why a row matters, as text."""
    parts = [F.when(F.col("is_mandatory"), "Mandatory"), F.when(F.col("domain_context") == "LEGAL", "Legal requirement")]
    said = F.concat_ws(", ", *parts)
    return F.when(said == "", "Standard weight").otherwise(said)


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def focus_items(reqs: DataFrame, k: int = 5) -> DataFrame:
    """The k incomplete rows of each project with the greatest impact; then mandatory ones, then input order."""
    order = Window.partitionBy("project_id").orderBy(F.desc("impact"), F.desc("is_mandatory"), "ord")
    ranked = with_impact(reqs).where("status <> 'ANSWERED'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("project_id", "rank", "requirement_id", shortened(F.col("text"), 80).alias("text"), F.nullif(F.col("section"), F.lit("")).alias("section"), "is_mandatory", "impact", reason().alias("reason"))


def potential(reqs: DataFrame, k: int = 5) -> DataFrame:
    return focus_items(reqs, k).groupBy("project_id").agg(F.sum("impact").alias("potential"))


def insights(reqs: DataFrame, criteria: DataFrame) -> DataFrame:
    """Heavy criteria under half done (high), drafts over limit (medium), undecided attestations (low), in that order."""
    heavy = linked(reqs, criteria.where("weight >= 20")).groupBy("project_id", "criterion_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ANSWERED").alias("done"))
    risk = heavy.where(percent(F.col("done"), F.col("n")) < 50).select("project_id", F.lit("risk").alias("kind"), F.lit("high").alias("priority"), F.col("criterion_id"), (F.col("n") - F.col("done")).alias("number"))
    pending = F.coalesce("is_attestation", F.lit(False)) & (F.col("compliance_status") == "PENDING") & (F.col("status") != "ANSWERED")
    none = F.lit(0).alias("criterion_id")  # no criterion
    per = reqs.groupBy("project_id").agg(F.count_if(over_limit()).alias("over"), F.count_if(pending).alias("pending"))
    over = per.where("over > 0").select("project_id", F.lit("over_limit").alias("kind"), F.lit("medium").alias("priority"), none, F.col("over").alias("number"))
    open_ = per.where("pending > 0").select("project_id", F.lit("attestation_pending").alias("kind"), F.lit("low").alias("priority"), none, F.col("pending").alias("number"))
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    order = Window.partitionBy("project_id").orderBy(rank, "criterion_id")
    return risk.unionByName(over).unionByName(open_).withColumn("place", F.row_number().over(order))


def title_map(reqs: DataFrame) -> DataFrame:
    """Of each category the first title given, as 'key: title'; the key where none is."""
    label = group_label()
    keyed = reqs.where(F.coalesce(label, F.lit("")) != "").select("project_id", "ord", major_category(label).alias("category"), category_title(label).alias("title"))
    first = F.min_by("title", F.when(F.col("title").isNotNull(), F.col("ord")))
    out = keyed.groupBy("project_id", "category").agg(first.alias("title"))
    return out.select("project_id", "category", F.coalesce(F.concat("category", F.lit(": "), "title"), "category").alias("title"))


def progress(reqs: DataFrame) -> DataFrame:
    """Matrix and reminder percentages: overall, mandatory, completion with halves."""
    answered = F.count_if(F.col("status") == "ANSWERED")
    return reqs.groupBy("project_id").agg(
        percent(answered, F.count(F.lit(1)), 0).alias("overall"),
        percent(F.count_if(F.col("is_mandatory") & (F.col("status") == "ANSWERED")), F.count_if(F.col("is_mandatory"))).alias("mandatory"),
        percent(F.sum(contribution2()), F.count(F.lit(1)) * 2).alias("completion"),
    )
