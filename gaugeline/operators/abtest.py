"""A/B statistics closed over moment rows. Inputs are cells (already aggregated), outputs are result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeline.functions import prob, tails
from gaugeline.functions.names import harm_direction_col
from gaugeline.functions.numbers import POSITIVE_INFINITY, mean_of, money_label, ratio, sample_variance_of, skewness_of

CONTROL, TREATMENT = "control", "treatment"
SKEW_LIMIT = 2.0
MDE_LEVELS = (1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 15.0, 20.0)


def require_arms(df: DataFrame, variant: str = "variant") -> None:
    """Raise unless both arms occur. One aggregate job, one result row."""
    row = df.agg(F.count_if(F.col(variant) == CONTROL).alias("c"), F.count_if(F.col(variant) == TREATMENT).alias("t"),
                 F.array_join(F.array_sort(F.slice(F.collect_set(F.col(variant).cast("string")), 1, 20)), ", ")
                 .alias("found")).first()
    if not row["c"] or not row["t"]:
        raise ValueError(f"'{variant}' must contain both 'control' and 'treatment'. Found: {row['found']}")


def arms_side_by_side(moments: DataFrame, by: list[str]) -> DataFrame:
    """Control and treatment moments on one row per ``by`` (columns ``n_c, s1_c, … n_t, …``)."""
    aggs = []
    for arm, tag in ((CONTROL, "c"), (TREATMENT, "t")):
        for c in ("n", "s1", "s2", "s3"):
            aggs.append(F.sum(F.when(F.col("variant") == arm, F.col(c))).alias(f"{c}_{tag}"))
    return moments.groupBy(*by).agg(*aggs)


def _describe_arms(pairs: DataFrame) -> DataFrame:
    out = pairs
    for tag, name in (("c", "control"), ("t", "treatment")):
        n, s1, s2, s3 = (F.col(f"{c}_{tag}") for c in ("n", "s1", "s2", "s3"))
        out = out.withColumns({
            f"n_{name}": F.coalesce(n, F.lit(0)).cast("bigint"),
            f"{name}_mean": mean_of(n, s1),
            f"{name}_var": sample_variance_of(n, s1, s2),
            f"{name}_skew": skewness_of(n, s1, s2, s3),
        })
    return out.drop(*[f"{c}_{tag}" for tag in "ct" for c in ("n", "s1", "s2", "s3")])


def welch_test(moments: DataFrame, by: list[str], alpha: float = 0.05, alternative: str = "two-sided") -> DataFrame:
    """Welch's t-test of treatment against control for every ``by`` group of the moments.

    ``status`` tells why a test is undefined; such rows keep null statistics.
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError("alternative must be 'two-sided', 'greater', or 'less'.")
    arms = _describe_arms(arms_side_by_side(moments, by))
    n_c, n_t = F.col("n_control"), F.col("n_treatment")
    q_c, q_t = ratio(F.col("control_var"), n_c), ratio(F.col("treatment_var"), n_t)
    arms = arms.withColumn(
        "status",
        F.when((n_c == 0) | (n_t == 0), "missing arm")
        .when((n_c < 2) | (n_t < 2), "too few observations")
        .when(q_c + q_t <= 0, "zero variance").otherwise("ok"))
    usable = F.col("status") == "ok"
    arms = arms.withColumns({
        "mean_diff": F.col("treatment_mean") - F.col("control_mean"),
        "std_err": F.when(usable, F.sqrt(q_c + q_t)),
        "dof": F.when(usable, ratio((q_c + q_t) * (q_c + q_t), ratio(q_t * q_t, n_t - 1) + ratio(q_c * q_c, n_c - 1))),
        "pooled_std": F.when(usable, F.sqrt(ratio(
            (n_t - 1) * F.col("treatment_var") + (n_c - 1) * F.col("control_var"), n_t + n_c - 2))),
    })
    arms = arms.withColumns({
        "t_stat": ratio(F.col("mean_diff"), F.col("std_err")),
        "cohens_d": F.when(usable, F.when(F.col("pooled_std") > 1e-12, ratio(F.col("mean_diff"), F.col("pooled_std")))
                           .otherwise(0.0)),
    })
    t, dof = F.col("t_stat"), F.col("dof")
    p_value = {"two-sided": tails.t_two_sided(t, dof), "greater": tails.t_sf(t, dof),
               "less": tails.t_sf(-t, dof)}[alternative]
    tail = alpha / 2 if alternative == "two-sided" else alpha
    arms = arms.withColumns({"p_value": p_value,
                             "t_crit": tails.t_ppf(F.when(usable, F.lit(1 - tail)), dof)})
    return arms.select(
        *by, "status", "n_control", "n_treatment", "control_mean", "treatment_mean", "control_var", "treatment_var",
        "mean_diff", "std_err", "t_stat", "dof", "p_value",
        (F.col("mean_diff") - F.col("t_crit") * F.col("std_err")).alias("ci_lower"),
        (F.col("mean_diff") + F.col("t_crit") * F.col("std_err")).alias("ci_upper"),
        (F.col("p_value") < alpha).alias("significant"), "cohens_d", "control_skew", "treatment_skew",
        ((F.abs("control_skew") > SKEW_LIMIT) | (F.abs("treatment_skew") > SKEW_LIMIT)).alias("skewed"),
        F.lit(alternative).alias("alternative"))


def cuped(joint: DataFrame, by: list[str] | None = None) -> DataFrame:
    """CUPED from joint moments per arm: theta pooled over every arm, effect of treatment against control."""
    by = by or []
    sums = [F.sum(c).alias(c) for c in ("j_n", "j_sy", "j_syy", "j_sx", "j_sxx", "j_sxy")]
    for arm, tag in ((CONTROL, "c"), (TREATMENT, "t")):
        for c in ("j_n", "j_sy", "j_sx"):
            sums.append(F.sum(F.when(F.col("variant") == arm, F.col(c))).alias(f"{c}_{tag}"))
    g = joint.groupBy(*by).agg(*sums) if by else joint.agg(*sums)
    n, sy, sx = F.col("j_n"), F.col("j_sy"), F.col("j_sx")
    g = g.withColumns({
        "var_x": ratio(F.col("j_sxx") - sx * ratio(sx, n), n - 1),
        "var_y": ratio(F.col("j_syy") - sy * ratio(sy, n), n - 1),
        "cov_xy": ratio(F.col("j_sxy") - sx * ratio(sy, n), n - 1),
        "mean_x": ratio(sx, n),
    })
    enough = F.coalesce((F.col("j_n_c") >= 2) & (F.col("j_n_t") >= 2), F.lit(False))
    varies = F.col("var_x") > 1e-9 * ratio(F.col("j_sxx"), n)
    g = g.withColumn("status", F.when(~enough, "too few observations").when(~varies, "constant covariate").otherwise("ok"))
    g = g.withColumn("theta", F.when(F.col("status") == "ok", ratio(F.col("cov_xy"), F.col("var_x"))))
    for tag in "ct":
        g = g.withColumn(f"adj_{tag}", ratio(F.col(f"j_sy_{tag}"), F.col(f"j_n_{tag}"))
                         - F.col("theta") * (ratio(F.col(f"j_sx_{tag}"), F.col(f"j_n_{tag}")) - F.col("mean_x")))
    after = F.col("var_y") + F.col("theta") * F.col("theta") * F.col("var_x") - 2.0 * F.col("theta") * F.col("cov_xy")
    return g.select(
        *by, "status", n.alias("n_users"),
        (ratio(F.col("j_sy_t"), F.col("j_n_t")) - ratio(F.col("j_sy_c"), F.col("j_n_c"))).alias("raw_ate"),
        (F.col("adj_t") - F.col("adj_c")).alias("cuped_ate"), "theta",
        F.when(F.col("var_y") > 0, (1 - ratio(after, F.col("var_y"))) * 100).otherwise(0.0).alias("variance_reduction_pct"))


def heterogeneous_effects(segments: DataFrame, alpha: float = 0.05, min_segment_size: int = 30,
                          share_over: str = "arms", interactions: DataFrame | None = None) -> DataFrame:
    """Welch test per segment with enough users in both arms, Bonferroni over the segments of a metric.

    ``share_over='arms'`` divides the two arms' users by all rows of the segment table;
    ``share_over='all'`` counts every arm of the segment. Rows are ordered significant first, then by effect size.
    With the rows of :func:`interaction_test` each one also has its metric's smallest interaction p-value, null if no column could be tested.
    """
    per_segment = segments.groupBy("metric", "segment").agg(F.sum("n").alias("seg_n"))
    totals = segments.groupBy("metric").agg(F.sum("n").alias("total_n"))
    tests = welch_test(segments, ["metric", "segment"], alpha).where(
        (F.col("n_control") >= min_segment_size) & (F.col("n_treatment") >= min_segment_size) & (F.col("status") == "ok"))
    numbers = tests.groupBy("metric").agg(F.count(F.lit(1)).alias("n_tests"))
    # Metrics are named by the caller, so these two have one row per named metric.
    kept = tests.join(per_segment, ["metric", "segment"]).join(F.broadcast(totals), "metric").join(F.broadcast(numbers), "metric")
    numerator = F.col("n_control") + F.col("n_treatment") if share_over == "arms" else F.col("seg_n")
    kept = kept.withColumns({
        "effect_size": F.col("mean_diff"), "segment_share": ratio(numerator.cast("double"), F.col("total_n"), 0.0),
        "significant": F.col("p_value") < F.lit(alpha) / F.col("n_tests")})
    shown = kept.select("metric", "segment", "effect_size", "segment_share", "control_mean", "treatment_mean",
                        "t_stat", "dof", "p_value", "significant", "n_control", "n_treatment", "n_tests")
    if interactions is not None:
        # one row per named metric
        shown = shown.join(F.broadcast(smallest_interaction(interactions).drop("segment_col")), "metric", "left")
    return shown.orderBy("metric", F.col("significant").desc(), F.abs("effect_size").desc(), "segment")


def top_segments(effects: DataFrame) -> DataFrame:
    """The reported segment per metric: significant first, then the largest effect."""
    key = F.struct((~F.col("significant")).alias("a"), (-F.abs("effect_size")).alias("b"), F.col("segment").alias("c"))
    best = F.min_by(F.struct("segment", "effect_size", "segment_share", "p_value", "significant"), key)
    return effects.groupBy("metric").agg(best.alias("t")).select("metric", "t.*")


def interaction_cells(cells: DataFrame, segment_cols: list[str], metrics: list[str], variant: str = "variant") -> DataFrame:
    """Moments per (metric, segment column, level, treated?) for the interaction test."""
    columns = F.array(*[F.struct(F.lit(c).alias("segment_col"), F.col(c).cast("string").alias("level"))
                        for c in segment_cols])
    kept = cells.dropna(subset=[*segment_cols, variant])
    exploded = kept.withColumn("_seg", F.explode(columns)).withColumns({
        "segment_col": F.col("_seg.segment_col"), "level": F.col("_seg.level"),
        "treated": F.col(variant) == TREATMENT})
    per_metric = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}__n").alias("n"), F.col(f"{m}__s1").alias("s1"),
                                    F.col(f"{m}__s2").alias("s2")) for m in metrics])
    long = exploded.select("segment_col", "level", "treated", F.explode(per_metric).alias("m")) \
        .select("m.metric", "segment_col", "level", "treated", "m.n", "m.s1", "m.s2").where("n > 0")
    return long.groupBy("metric", "segment_col", "level", "treated").agg(
        F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


def interaction_test(level_cells: DataFrame) -> DataFrame:
    """F-test of variant × segment from cell moments, per metric and segment column.

    The full model fits every cell mean, so its residual is the spread within
    cells. With level effects profiled out, the additive model's common effect is
    the average of the level effects weighted by n_c·n_t/(n_c+n_t), and the extra
    residual is their weighted spread around it.
    """
    side = lambda flag, c: F.sum(F.when(F.col("treated") == flag, F.col(c)))
    levels = level_cells.groupBy("metric", "segment_col", "level").agg(
        side(False, "n").alias("n0"), side(False, "s1").alias("a0"), side(True, "n").alias("n1"), side(True, "s1").alias("a1"),
        F.sum(F.col("s2") - ratio(F.col("s1") * F.col("s1"), F.col("n"))).alias("within"), F.sum("n").alias("n"))
    levels = levels.withColumns({
        "w": F.coalesce(ratio(F.col("n0") * F.col("n1"), F.col("n0") + F.col("n1")), F.lit(0.0)),
        "d": F.coalesce(ratio(F.col("a1"), F.col("n1")) - ratio(F.col("a0"), F.col("n0")), F.lit(0.0)),
    })
    totals = levels.groupBy("metric", "segment_col").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_levels"), F.sum("within").alias("ss_full"),
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("d")).alias("swd"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("swdd"))
    totals = totals.withColumn("ss_extra", F.greatest(F.col("swdd") - ratio(F.col("swd") * F.col("swd"), F.col("sw"), 0.0), F.lit(0.0)))
    d1, d2 = F.col("n_levels") - 1, F.col("n") - 2 * F.col("n_levels")
    usable = (F.col("n") >= 10) & F.col("n_levels").between(2, 50) & (d2 > 0) & (F.col("ss_full") > 0)
    tested = totals.where(usable).withColumns({"d1": d1, "d2": d2}).withColumn(
        "f_stat", ratio(F.col("ss_extra") / F.col("d1"), F.col("ss_full") / F.col("d2")))
    return tested.withColumn("p_value", tails.f_sf(F.col("f_stat"), F.col("d1").cast("double"), F.col("d2").cast("double"))) \
        .select("metric", "segment_col", "n", "n_levels", "ss_full", "ss_extra", "f_stat", "p_value")


def smallest_interaction(interactions: DataFrame) -> DataFrame:
    """Per metric the segment column whose interaction is surest, and its p-value; ties go to the first name."""
    least = F.min(F.struct("p_value", "segment_col"))
    return interactions.where("p_value IS NOT NULL").groupBy("metric").agg(least.alias("least")).select(
        "metric", F.col("least.segment_col").alias("segment_col"), F.col("least.p_value").alias("interaction_p_value"))


def sample_ratio(moments: DataFrame, by: list[str], expected_ratio: float = 0.5, alpha: float = 0.001) -> DataFrame:
    """Chi-square check of the arm sizes against the intended split."""
    if not 0 < expected_ratio < 1:
        raise ValueError("expected_ratio must be in (0, 1).")
    arms = arms_side_by_side(moments, by).select(
        *by, F.coalesce("n_c", F.lit(0)).cast("bigint").alias("n_control"),
        F.coalesce("n_t", F.lit(0)).cast("bigint").alias("n_treatment")).where("n_control >= 1 and n_treatment >= 1")
    total = F.col("n_control") + F.col("n_treatment")
    e_c, e_t = total * expected_ratio, total * (1 - expected_ratio)
    chi2 = F.pow(F.col("n_control") - e_c, F.lit(2.0)) / e_c + F.pow(F.col("n_treatment") - e_t, F.lit(2.0)) / e_t
    out = arms.withColumns({"expected_ratio": F.lit(expected_ratio), "chi2": chi2,
                            "observed_ratio": F.col("n_control") / total})
    out = out.withColumn("p_value", tails.chi2_sf(F.col("chi2"), F.lit(1.0)))
    return out.withColumn("srm_detected", F.col("p_value") < alpha)


def week_effects(weeks: DataFrame) -> DataFrame:
    """Difference in means per metric and week, for every week of the moments; null where an arm has no value."""
    mean = lambda arm: ratio(F.sum(F.when(F.col("variant") == arm, F.col("s1"))), F.sum(F.when(F.col("variant") == arm, F.col("n"))))
    return weeks.groupBy("metric", "week").agg((mean(TREATMENT) - mean(CONTROL)).alias("ate"))


def novelty(weeks: DataFrame) -> DataFrame:
    """Week-1 against week-2 effect per metric: direction and whether it looks like a novelty effect."""
    aggs = []
    for wk in (1, 2):
        for arm, tag in ((CONTROL, "c"), (TREATMENT, "t")):
            here = (F.col("week") == wk) & (F.col("variant") == arm)
            aggs += [F.sum(F.when(here, F.col("n"))).alias(f"n{wk}{tag}"), F.sum(F.when(here, F.col("s1"))).alias(f"s{wk}{tag}")]
    g = weeks.groupBy("metric").agg(*aggs)
    cells = ["1c", "1t", "2c", "2t"]
    complete = F.lit(True)
    for c in cells:
        complete = complete & (F.coalesce(F.col(f"n{c}"), F.lit(0)) >= 2)
    ate = lambda wk: ratio(F.col(f"s{wk}t"), F.col(f"n{wk}t")) - ratio(F.col(f"s{wk}c"), F.col(f"n{wk}c"))
    g = g.select("metric", F.when(complete, "ok").otherwise("skipped: weeks 1 and 2 need two users per arm").alias("status"),
                 F.when(complete, ate(1)).alias("week1_ate"), F.when(complete, ate(2)).alias("week2_ate"))
    a1, a2 = F.abs("week1_ate"), F.abs("week2_ate")
    flipped = (F.col("week1_ate") > 0) != (F.col("week2_ate") > 0)
    direction = (
        F.when(F.col("status") != "ok", F.lit(None).cast("string"))
        .when((a1 == 0) & (a2 == 0), "stable")
        .when(a1 == 0, F.when(F.col("week2_ate") > 0, "growing").otherwise("decaying"))
        .when(a2 > a1 * 1.10, "growing").when(a2 < a1 * 0.90, "decaying")
        .when(flipped & (a2 > 0), "decaying").otherwise("stable"))
    g = g.withColumn("effect_direction", direction)
    likely = (F.col("effect_direction") == "decaying") & (a1 > 0) & ((a2 < 0.5 * a1) | ((a2 > 0) & flipped))
    return g.withColumn("novelty_likely", F.coalesce(likely, F.lit(False)))


def guardrails(moments: DataFrame, alpha: float = 0.05, default_direction: str = "both",
               harm_directions: dict[str, str] | None = None) -> DataFrame:
    """Two-sided Welch test per guardrail metric; a breach is significant, harmful and survives Bonferroni."""
    tests = welch_test(moments, ["metric"], alpha).where("status = 'ok'")
    named = harm_direction_col(F.col("metric"))
    direction = F.when(named == "both", F.lit(default_direction)).otherwise(named)
    if harm_directions:
        given = F.create_map(*[F.lit(x) for pair in harm_directions.items() for x in pair])
        direction = F.coalesce(given[F.col("metric")], direction)
    m_c, m_t = F.col("control_mean"), F.col("treatment_mean")
    harmful = F.when(F.col("direction") == "increase", m_t > m_c).when(F.col("direction") == "decrease", m_t < m_c).otherwise(True)
    out = tests.withColumns({"direction": direction, "n_tests": F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))})
    return out.select(
        "metric", "direction", "control_mean", "treatment_mean",
        F.when(m_c != 0, ratio(m_t - m_c, F.abs(m_c)) * 100).otherwise((m_t - m_c) * 100).alias("delta_pct"),
        "t_stat", "dof", "p_value", "n_tests",
        ((F.col("p_value") < alpha) & harmful & (F.col("p_value") < F.lit(alpha) / F.col("n_tests"))).alias("breached"))


def detectable_effect(tests: DataFrame, alpha: float = 0.05, power: float = 0.80,
                      observed: str | None = "mean_diff") -> DataFrame:
    """Minimum detectable effect of each test row (``n_*``, ``control_mean``, ``control_var``), and post-hoc power."""
    z = prob.norm_ppf(1 - alpha / 2) + prob.norm_ppf(power)
    n_c, n_t = F.col("n_control").cast("double"), F.col("n_treatment").cast("double")
    usable = tests.where((F.col("n_control") >= 2) & (F.col("n_treatment") >= 2) & (F.col("control_var") > 0))
    out = usable.withColumn("_se", F.sqrt("control_var") * F.sqrt(1 / n_c + 1 / n_t)).withColumn("mde_absolute", F.col("_se") * z)
    out = out.withColumn("mde_relative_pct", F.when(F.col("control_mean") == 0, F.lit(POSITIVE_INFINITY))
                         .otherwise(ratio(F.col("mde_absolute"), F.abs("control_mean")) * 100))
    if observed is None:
        return out.drop("_se")
    out = out.withColumns({
        "is_powered": F.abs(observed) >= F.col("mde_absolute"),
        "ncp": F.when(F.col("_se") >= 1e-12, ratio(F.abs(observed), F.col("_se"))),
    })
    return out.withColumn("post_hoc_power", tails.post_hoc_power(F.col("ncp"), n_c + n_t - 2, F.lit(alpha))).drop("_se")


def required_sample_size(mean: Column, std: Column, mde_pct: Column, alpha: float = 0.05, power: float = 0.80) -> Column:
    """Users per arm needed to detect ``mde_pct`` percent of the mean."""
    z = prob.norm_ppf(1 - alpha / 2) + prob.norm_ppf(power)
    return F.ceil(2 * F.pow(ratio(z * std, F.abs(mean) * mde_pct / 100), F.lit(2.0)))


def power_table(events: DataFrame, metric: str, user: str, date: str, alpha: float = 0.05, power: float = 0.80,
                levels: tuple[float, ...] = MDE_LEVELS) -> DataFrame:
    """Baseline of the metric over the whole table and the sample each effect size needs, one row per level."""
    y = F.col(metric).cast("double")
    base = events.agg(F.avg(y).alias("baseline_mean"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("baseline_std"),
                      F.count_distinct(user).alias("total_users"), F.count_distinct(date).alias("total_days"))
    base = base.where("baseline_mean <> 0 and baseline_std > 0").withColumn(
        "daily_traffic", F.col("total_users") / F.greatest("total_days", F.lit(1)))
    rows = base.withColumn("mde_pct", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    rows = rows.withColumns({
        "mde_absolute": F.abs("baseline_mean") * F.col("mde_pct") / 100,
        "n_per_arm": required_sample_size(F.col("baseline_mean"), F.col("baseline_std"), F.col("mde_pct"), alpha, power),
    })
    days = F.ceil(2 * F.col("n_per_arm") / F.greatest("daily_traffic", F.lit(1.0)))
    return rows.withColumns({"total_n": 2 * F.col("n_per_arm"), "runtime_days": F.greatest(days, F.lit(1))})


def business_impact(mde: DataFrame, metric_label: str, units: int, value_per_unit: float = 0.50) -> DataFrame:
    """Daily value of an effect of the size of the detectable one, as a number and a sentence."""
    if units <= 0:
        raise ValueError("units must be positive.")
    value = F.lit(float(units)) * F.col("mde_relative_pct") / 100 * value_per_unit
    out = mde.withColumn("daily_value", value)
    return out.withColumn("impact", F.when(
        F.col("daily_value") < POSITIVE_INFINITY,
        F.concat(F.lit("At MDE of "), F.format_string("%.1f", "mde_relative_pct"),
                 F.lit(f"%, detects a {metric_label} lift worth "), money_label(F.col("daily_value")),
                 F.lit("/day at current scale."))))
