"""Accounts and reports: plans and quotas, what is to be cleaned up, the dashboard, and the joined report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqloom.operators import scoring

# Extractions a month by plan (-1: no limit), and the plans that can be granted.
PLAN_LIMITS = {"FREE": 0, "STARTER": 2, "PRO": 10, "BUSINESS": -1, "ENTERPRISE": -1}
GRANTABLE = ("STARTER", "PRO", "BUSINESS")
# Bounds of a valid sum of weights.
LEAST_WEIGHT, MOST_WEIGHT = 95, 105


def new_billing_period(last: Column, now: Column) -> Column:
    """Whether month or year differ."""
    return F.date_trunc("month", last) != F.date_trunc("month", now)


def granted(plan: Column, subscription: Column) -> Column:
    """A paid plan without a subscription."""
    return plan.isin(*GRANTABLE) & subscription.isNull()


def grant_expired(plan: Column, subscription: Column, period_end: Column, now: Column) -> Column:
    return granted(plan, subscription) & F.coalesce(period_end < now, F.lit(False))


def credits_expired(expires: Column, extractions: Column, drafts: Column, now: Column) -> Column:
    """Past the expiry with something left to take away."""
    return F.coalesce(expires < now, F.lit(False)) & ((extractions > 0) | (drafts > 0))


def referred(referrer: Column) -> Column:
    return referrer.isNotNull()


def valid_id(id_: Column) -> Column:
    """The shape of record ids: c and 24 small letters or digits."""
    return F.coalesce(id_.rlike(r"^c[a-z0-9]{24}\z"), F.lit(False))


def with_quota(users: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """users (plan, subscription, period_end, used, last_reset) with effective plan, limit, used in this period, remaining (-1: no limit) and allowed. plans: plan, limit, one row a plan."""
    plan = F.when(grant_expired(F.col("plan"), F.col("subscription"), F.col("period_end"), now), "FREE").otherwise(F.col("plan"))
    used = F.when(new_billing_period(F.col("last_reset"), now), 0).otherwise(F.col("used"))
    named = users.withColumn("effective_plan", plan).withColumn("used", used).join(plans.withColumnRenamed("plan", "effective_plan"), "effective_plan", "left")
    named = named.withColumn("limit", F.coalesce("limit", F.lit(PLAN_LIMITS["FREE"])))
    unlimited = F.col("limit") == -1
    return named.withColumn("remaining", F.when(unlimited, -1).otherwise(F.greatest(F.lit(0), F.col("limit") - F.col("used")))).withColumn("allowed", unlimited | (F.col("used") < F.col("limit")))


def valid_weights(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """Sum of the weights of a key, and whether it is about a hundred."""
    return rows.groupBy(key).agg(F.sum(weight).alias("total")).withColumn("valid", F.col("total").between(LEAST_WEIGHT, MOST_WEIGHT))


def dashboard_side(percent: Column, past_deadline: Column, status: Column) -> Column:
    """active or completed. Done or overdue projects are completed, unless they are being processed or have failed."""
    return F.when(status.isin("PROCESSING", "FAILED"), "active").when((percent >= 100) | F.coalesce(past_deadline, F.lit(False)), "completed").otherwise("active")


def report(reqs: DataFrame, criteria: DataFrame, ready: DataFrame) -> DataFrame:
    """The enhanced summary of a project: scores, whether it is ready, number of issues, insights, possible gain and first focus item. ready: scoring.readiness's rows."""
    overall = scoring.criteria_overall(reqs, criteria).withColumnRenamed("overall", "criteria_score")
    issues = ready.groupBy("project_id").agg(F.min(F.col("ready").cast("int")).cast("boolean").alias("ready"), F.count(F.lit(1)).alias("issues"))
    found = scoring.insights(reqs, criteria).groupBy("project_id").agg(F.count(F.lit(1)).alias("insights"))
    focus = scoring.focus_items(reqs)
    gain = focus.groupBy("project_id").agg(F.sum("impact").alias("potential"), F.max(F.when(F.col("rank") == 1, F.col("requirement_id"))).alias("first_focus"))
    out = overall
    for part in (scoring.progress(reqs), issues, found, gain):
        out = out.join(part, "project_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("project_id", "criteria_score", "mandatory", "completion", F.coalesce("ready", F.lit(True)).alias("ready"), zero("issues"), zero("insights"), zero("potential"), "first_focus")
