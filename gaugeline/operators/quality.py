"""Content checks on an extract, confidence levels, and the decision table over experiment results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.functions.names import entity_column, is_rate_metric
from gaugeline.functions.numbers import ratio


def content_checks(df: DataFrame, metric: str | None, mode: str = "ab_test", variant: str = "variant", week: str = "week") -> DataFrame:
    """One row per check of an extract: ``(check, fired, detail)``; everything comes from one aggregate."""
    entity = entity_column(df.columns)
    nothing = F.lit(None)
    ab = mode == "ab_test" and variant in df.columns
    arm = F.lower(F.col(variant).cast("string")) if ab else nothing.cast("string")
    value = F.col(metric).cast("double") if metric and metric in df.columns else nothing.cast("double")
    one = lambda cond: F.count_distinct(cond)
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(arm.contains("control")).alias("n_control"),
        F.count_if(arm.contains("treatment")).alias("n_treatment"), F.count(value).alias("n_metric"),
        F.count_if(value > 1.0).alias("n_over"), one(F.col(entity) if entity else nothing).alias("n_entities"),
        one(F.col(variant) if ab else nothing).alias("n_variants"), one(F.col(week) if ab and week in df.columns else nothing).alias("n_weeks"))
    r = F.col("rows")
    both = (F.col("n_control") > 0) & (F.col("n_treatment") > 0)
    minority = ratio(F.least("n_control", "n_treatment").cast("double"), F.col("n_control") + F.col("n_treatment"))
    over = ratio(F.col("n_over").cast("double"), F.col("n_metric"))
    expected = F.col("n_entities") * F.greatest("n_variants", F.lit(1)) * F.greatest("n_weeks", F.lit(1))
    check = lambda name, fired, measure: F.struct(F.lit(name).alias("check"), F.coalesce(fired, F.lit(False)).alias("fired"),
                                                  measure.cast("double").alias("measure"))
    checks = [check("no_rows", r == 0, r), check("too_few_rows", r.between(1, 9), r)]
    if ab:
        checks += [check("missing_arm", (r > 0) & ~both, F.col("n_control") * F.lit(1.0)), check("arm_imbalance", both & (minority < 0.30), minority),
                   check("percentage_not_rate", F.lit(bool(metric and is_rate_metric(metric))) & (over > 0.8), over)]
    if entity:
        per = ratio(r.cast("double"), F.greatest("n_entities", F.lit(1)))
        fan = ratio(r.cast("double"), expected)
        checks.append(check("join_fan_out", (F.col("n_entities") > 0) & ((fan > 3) if ab else (per > 5)), fan if ab else per))
    return facts.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def confidence_level(tests: DataFrame) -> DataFrame:
    """Confidence in each A/B test row from p-value, effect size, interval width and sample size."""
    d, middle = F.abs("cohens_d"), (F.col("ci_lower") + F.col("ci_upper")) / 2
    wide = F.when(F.abs(middle) > 1e-9, F.abs(F.col("ci_upper") - F.col("ci_lower")) > 2 * F.abs(middle)).otherwise(False)
    smallest = F.least("n_control", "n_treatment")
    sig = F.coalesce(F.col("significant"), F.lit(False))
    level = F.when(sig & (F.col("p_value") < 0.01) & (d >= 0.2) & ~wide, "high").when(sig, "medium").otherwise("low")
    reason = (F.when(sig & (F.col("p_value") < 0.01) & (d >= 0.2) & ~wide, "robust result")
              .when(sig & (d < 0.1), "significant but negligible effect")
              .when(sig & wide, "significant but the interval is wide relative to the effect")
              .when(sig & (smallest < 100), "significant but small sample")
              .when(sig, "significant but borderline p-value").otherwise("not statistically significant"))
    return tests.withColumns({"confidence_level": level, "confidence_reason": reason})


def row_count_confidence(n_rows: Column) -> Column:
    return F.when(n_rows >= 1000, "high").when(n_rows >= 100, "medium").otherwise("low")


def effect_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.1, "negligible").when(a < 0.2, "small").when(a < 0.5, "medium").when(a.isNotNull(), "large")


def decisions(results: DataFrame) -> DataFrame:
    """Recommended action per experiment row.

    Needs ``srm_detected, significant, any_breached, is_powered, n_control, n_treatment, mde_relative_pct, cohens_d,
    ci_lower, ci_upper, post_hoc_power``.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    sig, breached = flag("significant"), flag("any_breached")
    underpowered = ~F.coalesce(F.col("is_powered"), F.lit(True))
    have = F.least("n_control", "n_treatment")
    scale = F.greatest(F.pow(F.col("mde_relative_pct") / 5.0, F.lit(2.0)), F.lit(1.5))
    need = F.when(~sig & underpowered & (have > 0) & (F.col("mde_relative_pct") > 0), F.floor(have * scale).cast("bigint"))
    action = (F.when(flag("srm_detected"), "stop: fix randomization").when(sig & breached, "roll back")
              .when(sig, "investigate before shipping").when(underpowered, "extend: insufficient data").otherwise("collect more data"))
    middle = (F.col("ci_lower") + F.col("ci_upper")) / 2
    return results.withColumns({
        "action": action, "needed_per_arm": need, "shortfall": F.greatest(need - have, F.lit(0)).cast("bigint"),
        "effect_label": effect_label(F.col("cohens_d")),
        "winners_curse": sig & F.coalesce(F.col("post_hoc_power") < 0.50, F.lit(False)),
        "inconclusive": ~sig & underpowered,
        "negligible_effect": sig & (F.abs("cohens_d") < 0.1),
        "wide_interval": (F.abs(middle) > 1e-9) & ((F.col("ci_upper") - F.col("ci_lower")) > 2 * F.abs(middle)),
        "small_sample": (have > 0) & (have < 100)})


def compare_with_baseline(baseline: DataFrame, current: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Score regressions per evaluation: a drop beyond the tolerance, fewer passes, or no baseline entry."""
    b = baseline.select("name", F.col("score").alias("base_score"), F.col("n_pass").alias("base_pass"))
    joined = current.join(b, "name", "full_outer")
    verdict = (F.when(F.col("score").isNull(), "not run").when(F.col("base_score").isNull(), "no baseline entry")
               .when(F.col("base_score") - F.col("score") > tolerance, "score dropped")
               .when(F.col("n_pass") < F.col("base_pass"), "pass count dropped").otherwise("ok"))
    return joined.select("name", "base_score", "score", "base_pass", "n_pass", verdict.alias("verdict"))
