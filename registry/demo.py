"""How the driver tables stand in for experiment tables, in Spark and as SQL text for the checks.

The driver's events carry no experiment, so arms, platforms and segments follow from the user id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.sources.tables import load
from gaugeline.spec import ExperimentSpec

START = "2024-01-15"
FUNNEL_STEPS = ("view", "click", "signup", "purchase")

SPEC = ExperimentSpec(
    primary_metric="avg_value", metric_source_col="value", covariate="pre_value", covariate_source_col="value",
    guardrail_metrics=("error_rate", "click_share"), segment_cols=("platform", "user_segment"),
    funnel_steps=FUNNEL_STEPS, experiment_start=START, experiment_weeks=2)


def _platform(user):
    return F.when(user % 3 == 0, "android").when(user % 3 == 1, "ios").otherwise("web")


def _segment(user):
    return F.when(user % 5 == 0, "new").when(user % 5 <= 2, "returning").otherwise("power")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return load(spark, sf_dir, "events").select(
        "event_id", "ts", F.to_date("ts").alias("date"), "user_id", "event_type", "value",
        (F.col("event_type") == "error").cast("int").alias("error_rate"),
        (F.col("event_type") == "click").cast("int").alias("click_share"),
        _platform(user).alias("platform"), _segment(user).alias("user_segment"))


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two assignment rows per user, one per week."""
    users = load(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        "user_id", F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("variant"),
        F.lit(START).cast("date").alias("assignment_date"), F.explode(F.array(F.lit(1), F.lit(2))).alias("week"))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long funnel rows: a step is completed when the user has an event of that type worth 20 or more."""
    return load(spark, sf_dir, "events").where(F.col("event_type").isin(*FUNNEL_STEPS)).select(
        "user_id", F.col("event_type").alias("step"), (F.col("value") >= 20).cast("int").alias("completed"))


EVENTS_SQL = """ev AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS date, user_id, event_type, value,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_rate,
         CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS click_share,
         CASE user_id % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'web' END AS platform,
         CASE WHEN user_id % 5 = 0 THEN 'new' WHEN user_id % 5 <= 2 THEN 'returning' ELSE 'power' END AS user_segment
  FROM events)"""

EXPERIMENT_SQL = f"""ex AS (
  SELECT u.user_id, CASE WHEN u.user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant,
         DATE '{START}' AS assignment_date, w.week
  FROM (SELECT DISTINCT user_id FROM events) u, (VALUES (1), (2)) w(week))"""

# The user-level extract: one row per user, week and segments.
EXTRACT_SQL = f"""{EVENTS_SQL},
{EXPERIMENT_SQL},
during AS (
  SELECT user_id, platform, user_segment, CAST(date_diff('day', DATE '{START}', date) // 7 + 1 AS INTEGER) AS week,
         avg(value) AS avg_value, avg(error_rate) AS error_rate, avg(click_share) AS click_share
  FROM ev WHERE date >= DATE '{START}' GROUP BY ALL),
pre AS (SELECT user_id, avg(value) AS pre_value FROM ev WHERE date < DATE '{START}' GROUP BY user_id),
xt AS (
  SELECT d.user_id, a.variant, d.week, d.avg_value, coalesce(p.pre_value, 0) AS pre_value, d.error_rate, d.click_share,
         d.platform, d.user_segment
  FROM during d JOIN (SELECT DISTINCT user_id, variant FROM ex) a USING (user_id) LEFT JOIN pre p USING (user_id))"""

FUNNEL_SQL = """fu AS (
  SELECT user_id, event_type AS step, CASE WHEN value >= 20 THEN 1 ELSE 0 END AS completed
  FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase'))"""


# Tail probabilities for the checks, by Simpson's rule over smooth substitutions.

def _simpson(integrand: str, upper: str, n: int = 2000) -> str:
    """Integral of ``integrand`` (a function of ``{x}``) from 0 to ``upper``."""
    x = f"(({upper}) * i / {n}.0::DOUBLE)"
    weight = f"(CASE WHEN i = 0 OR i = {n} THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END)"
    body = integrand.replace("{x}", x)
    return f"(list_sum(list_transform(generate_series(0, {n}), lambda i: {weight} * ({body}))) * ({upper}) / {3 * n}.0::DOUBLE)"


def t_two_sided_sql(t: str, dof: str) -> str:
    const = f"exp(lgamma((({dof}) + 1) / 2) - lgamma(({dof}) / 2)) / sqrt(pi())"
    area = _simpson(f"pow(cos({{x}}), ({dof}) - 1)", f"atan(abs({t}) / sqrt({dof}))")
    return f"(1 - 2 * {const} * {area})"


def normal_two_sided_sql(z: str) -> str:
    area = _simpson("exp(-{x} * {x} / 2)", f"abs({z})")
    return f"(1 - 2 * {area} / sqrt(2 * pi()))"


def f_upper_sql(f: str, d1: str, d2: str) -> str:
    const = f"exp(lgamma((({d1}) + ({d2})) / 2) - lgamma(({d1}) / 2) - lgamma(({d2}) / 2))"
    area = _simpson(f"pow(sin({{x}}), ({d1}) - 1) * pow(cos({{x}}), ({d2}) - 1)",
                    f"asin(sqrt(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2}))))")
    return f"(1 - 2 * {const} * {area})"
