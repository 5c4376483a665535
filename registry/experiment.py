"""Experiment queries: extract, moments, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.operators import abtest, moments, quantiles, winsor
from gaugeline.plans import experiment as plan
from registry import demo
from registry.base import query

ARMS = "variant IN ('control', 'treatment')"
WELCH_COLUMNS = """
  'ok' AS status, n_control, n_treatment, m_c AS control_mean, m_t AS treatment_mean, v_c AS control_var, v_t AS treatment_var,
  m_t - m_c AS mean_diff, sqrt(v_t / n_treatment + v_c / n_control) AS std_err,
  (m_t - m_c) / sqrt(v_t / n_treatment + v_c / n_control) AS t_stat,
  pow(v_t / n_treatment + v_c / n_control, 2)
    / (pow(v_t / n_treatment, 2) / (n_treatment - 1) + pow(v_c / n_control, 2) / (n_control - 1)) AS dof,
  (m_t - m_c) / sqrt(((n_treatment - 1) * v_t + (n_control - 1) * v_c) / (n_treatment + n_control - 2)) AS cohens_d"""


def arms_sql(metric: str, by: str = "", source: str = "xt", where: str = "TRUE") -> str:
    """Two-pass arm summaries, independent of the moment formulas under test."""
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}count({metric}) FILTER (variant = 'control') AS n_control,
      count({metric}) FILTER (variant = 'treatment') AS n_treatment,
      avg({metric}) FILTER (variant = 'control') AS m_c, avg({metric}) FILTER (variant = 'treatment') AS m_t,
      var_samp({metric}) FILTER (variant = 'control') AS v_c, var_samp({metric}) FILTER (variant = 'treatment') AS v_t
    FROM {source} WHERE {where} {'GROUP BY ' + by if by else ''}"""


def extract(spark, sf_dir):
    return plan.experiment_extract(demo.events(spark, sf_dir), demo.experiment(spark, sf_dir), demo.SPEC)


def cells(spark, sf_dir):
    return plan.experiment_cells(extract(spark, sf_dir), demo.SPEC)


@query("flagship_ab_test", "A8 C1 D1 D2 D11 D12 D15", f"""WITH {demo.EXTRACT_SQL},
arms AS ({arms_sql('avg_value')}),
test AS (SELECT {WELCH_COLUMNS} FROM arms),
pooled AS (SELECT regr_slope(avg_value, pre_value) AS theta, avg(pre_value) AS mx, var_samp(avg_value) AS vy,
           var_samp(pre_value) AS vx, covar_samp(avg_value, pre_value) AS cxy, count(*) AS n_users FROM xt),
means AS (SELECT avg(avg_value) FILTER (variant = 'treatment') AS yt, avg(avg_value) FILTER (variant = 'control') AS yc,
          avg(pre_value) FILTER (variant = 'treatment') AS xt_, avg(pre_value) FILTER (variant = 'control') AS xc FROM xt)
SELECT 'avg_value' AS metric, test.*, {demo.t_two_sided_sql('t_stat', 'dof')} AS p_value,
       {demo.t_two_sided_sql('t_stat', 'dof')} < 0.05 AS significant,
       n_users, yt - yc AS raw_ate, (yt - theta * (xt_ - mx)) - (yc - theta * (xc - mx)) AS cuped_ate, theta,
       (1 - (vy + theta * theta * vx - 2 * theta * cxy) / vy) * 100 AS variance_reduction_pct
FROM test, pooled, means""",
       "control_mean treatment_mean control_var treatment_var mean_diff std_err t_stat dof cohens_d p_value "
       "raw_ate cuped_ate theta variance_reduction_pct")
def flagship_ab_test(spark, sf_dir):
    out = plan.flagship(demo.events(spark, sf_dir), demo.experiment(spark, sf_dir), demo.SPEC)
    return out.drop("ci_lower", "ci_upper", "control_skew", "treatment_skew", "skewed", "alternative")


@query("experiment_extract", "B3 C1 C2 C3", f"WITH {demo.EXTRACT_SQL} SELECT * FROM xt",
       "avg_value pre_value error_rate click_share")
def experiment_extract(spark, sf_dir):
    return extract(spark, sf_dir)


@query("experiment_extract_by_assignment", "C1 C3", f"""WITH {demo.EVENTS_SQL}, {demo.EXPERIMENT_SQL},
during AS (SELECT user_id, platform, user_segment, sum(value) AS avg_value, avg(error_rate) AS error_rate,
             avg(click_share) AS click_share
           FROM ev WHERE date >= (SELECT min(assignment_date) FROM ex) GROUP BY ALL),
pre AS (SELECT user_id, sum(value) AS pre_value FROM ev WHERE date < (SELECT min(assignment_date) FROM ex) GROUP BY ALL)
SELECT d.user_id, ex.variant, ex.week, d.avg_value, coalesce(pre_value, 0) AS pre_value, error_rate, click_share,
       platform, user_segment
FROM during d JOIN ex USING (user_id) LEFT JOIN pre USING (user_id)""",
       "error_rate click_share", {"avg_value": 4, "pre_value": 4})
def experiment_extract_by_assignment(spark, sf_dir):
    from dataclasses import replace
    spec = replace(demo.SPEC, experiment_start=None, metric_agg="sum")
    return plan.experiment_extract(demo.events(spark, sf_dir), demo.experiment(spark, sf_dir), spec, week_from="assignment")


@query("events_from_text_date", "C3", f"""WITH {demo.EVENTS_SQL}, {demo.EXPERIMENT_SQL}
SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM ev
WHERE CAST(date AS VARCHAR) >= (SELECT CAST(min(assignment_date) AS VARCHAR) FROM ex) GROUP BY 1""")
def events_from_text_date(spark, sf_dir):
    ev = demo.events(spark, sf_dir).withColumn("date", F.col("date").cast("string"))
    kept = plan.text_date_extract_cut(ev, demo.experiment(spark, sf_dir), demo.SPEC)
    return kept.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("variant_moments", "B2 D1 D3", f"""WITH {demo.EXTRACT_SQL}
SELECT 'avg_value' AS metric, variant, count(avg_value) AS n, sum(avg_value) AS s1, sum(avg_value ** 2) AS s2,
       sum(avg_value ** 3) AS s3, CAST(count(*) FILTER (avg_value > 1) AS BIGINT) AS gt1
FROM xt GROUP BY variant""", "", {"s1": 4, "s2": 2, "s3": 0})
def variant_moments(spark, sf_dir):
    return moments.long_moments(cells(spark, sf_dir), ["variant"], ["avg_value"])


@query("joint_moments", "D2", f"""WITH {demo.EXTRACT_SQL}
SELECT variant, CAST(count(*) AS BIGINT) AS j_n, sum(avg_value) AS j_sy, sum(avg_value ** 2) AS j_syy, sum(pre_value) AS j_sx,
       sum(pre_value ** 2) AS j_sxx, sum(avg_value * pre_value) AS j_sxy
FROM xt WHERE avg_value IS NOT NULL AND pre_value IS NOT NULL GROUP BY variant""",
       "", {"j_sy": 4, "j_syy": 2, "j_sx": 4, "j_sxx": 2, "j_sxy": 2})
def joint_moments(spark, sf_dir):
    return moments.joint_moments(cells(spark, sf_dir))


@query("moments_all_grains", "D4 D5 D6 D8 D9", f"""WITH {demo.EXTRACT_SQL},
long AS (SELECT 'avg_value' AS metric, avg_value AS y, * FROM xt UNION ALL SELECT 'error_rate', error_rate, * FROM xt
         UNION ALL SELECT 'click_share', click_share, * FROM xt)
SELECT CASE WHEN GROUPING(platform) = 0 THEN 'segment' WHEN GROUPING(week) = 0 THEN 'week' ELSE 'overall' END AS grain,
       CASE WHEN GROUPING(platform) = 0 THEN 'platform=' || platform || ',user_segment=' || user_segment
            WHEN GROUPING(week) = 0 THEN CAST(week AS VARCHAR) ELSE '' END AS key,
       metric, variant, count(y) AS n, sum(y) AS s1, sum(y ** 2) AS s2, sum(y ** 3) AS s3
FROM long
GROUP BY GROUPING SETS ((metric, variant), (metric, variant, week), (metric, variant, platform, user_segment))""",
       "", {"s1": 4, "s2": 2, "s3": 0})
def moments_all_grains(spark, sf_dir):
    return moments.all_grains(cells(spark, sf_dir), ["avg_value", "error_rate", "click_share"], list(demo.SPEC.segment_cols))


@query("extract_shape", "D7", f"""WITH {demo.EXTRACT_SQL}
SELECT count(*) AS total_rows, count(DISTINCT user_id) AS n_entities, count(DISTINCT week) AS n_weeks,
       count(DISTINCT variant) AS n_variants FROM xt""")
def extract_shape(spark, sf_dir):
    return moments.shape_facts(extract(spark, sf_dir), "user_id", "week")


@query("arm_preview", "D10", f"""WITH {demo.EXTRACT_SQL}
SELECT variant, avg(avg_value) AS mean_metric, avg(pre_value) AS mean_covariate, count(avg_value) AS n_users
FROM xt GROUP BY variant""", "mean_metric mean_covariate")
def arm_preview(spark, sf_dir):
    return moments.arm_preview(cells(spark, sf_dir), "avg_value")


@query("moment_statistics", "D11", f"""WITH {demo.EXTRACT_SQL},
m AS (SELECT variant, avg(avg_value) AS mu FROM xt GROUP BY variant)
SELECT variant, any_value(mu) AS mean, var_samp(avg_value) AS variance,
       avg(pow(avg_value - mu, 3)) / pow(avg(pow(avg_value - mu, 2)), 1.5) AS skewness
FROM xt JOIN m USING (variant) GROUP BY variant""", "mean variance skewness")
def moment_statistics(spark, sf_dir):
    from gaugeline.functions.numbers import mean_of, sample_variance_of, skewness_of
    long = moments.long_moments(cells(spark, sf_dir), ["variant"], ["avg_value"])
    n, s1, s2, s3 = (F.col(c) for c in ("n", "s1", "s2", "s3"))
    return long.select("variant", mean_of(n, s1).alias("mean"), sample_variance_of(n, s1, s2).alias("variance"),
                       skewness_of(n, s1, s2, s3).alias("skewness"))


TWO_SIDED = demo.t_two_sided_sql('t_stat', 'dof')


@query("welch_test_directed", "B4 D12 D13", f"""WITH RECURSIVE {demo.EXTRACT_SQL},
arms AS ({arms_sql('avg_value')}),
test AS (SELECT {WELCH_COLUMNS} FROM arms),
crit AS (
  SELECT dof, 0.0::DOUBLE AS low, 50.0::DOUBLE AS high, 0 AS step FROM test
  UNION ALL
  SELECT dof, CASE WHEN {demo.t_two_sided_sql('(low + high) / 2', 'dof')} / 2 > 0.05 THEN (low + high) / 2 ELSE low END,
         CASE WHEN {demo.t_two_sided_sql('(low + high) / 2', 'dof')} / 2 > 0.05 THEN high ELSE (low + high) / 2 END, step + 1
  FROM crit WHERE step < 50),
tails AS (SELECT test.*, {TWO_SIDED} / 2 AS half FROM test)
SELECT 'avg_value' AS metric, tails.* EXCLUDE (half),
       CASE WHEN t_stat >= 0 THEN half ELSE 1 - half END AS p_value,
       mean_diff - high * std_err AS ci_lower, mean_diff + high * std_err AS ci_upper,
       CASE WHEN t_stat >= 0 THEN half ELSE 1 - half END < 0.05 AS significant, 'greater' AS alternative
FROM tails, (SELECT high FROM crit WHERE step = 50)""",
       "control_mean treatment_mean control_var treatment_var mean_diff std_err t_stat dof cohens_d p_value ci_lower ci_upper")
def welch_test_directed(spark, sf_dir):
    long = moments.long_moments(cells(spark, sf_dir), ["variant"], ["avg_value"])
    return abtest.welch_test(long, ["metric"], alternative=demo.SPEC.alternative).drop("control_skew", "treatment_skew", "skewed")


@query("winsorised_welch_test", "B10 D14", f"""WITH {demo.EXTRACT_SQL},
bounds AS (SELECT variant, quantile_cont(avg_value, 0.05) AS lo, quantile_cont(avg_value, 0.95) AS hi FROM xt GROUP BY variant),
clipped AS (SELECT variant, least(greatest(avg_value, lo), hi) AS y FROM xt JOIN bounds USING (variant)),
arms AS ({arms_sql('y', source='clipped')}),
test AS (SELECT {WELCH_COLUMNS} FROM arms)
SELECT 'avg_value' AS metric, *, {TWO_SIDED} AS p_value, {TWO_SIDED} < 0.05 AS significant FROM test""",
       "control_mean treatment_mean control_var treatment_var mean_diff std_err t_stat dof cohens_d p_value")
def winsorised_welch_test(spark, sf_dir):
    clipped = winsor.winsorise(extract(spark, sf_dir), "avg_value", 0.05)
    long = moments.long_moments(moments.cell_moments(clipped, ["variant"], ["avg_value"]), ["variant"], ["avg_value"])
    return abtest.welch_test(long, ["metric"]).drop(
        "ci_lower", "ci_upper", "control_skew", "treatment_skew", "skewed", "alternative")


@query("cuped", "D15", f"""WITH {demo.EXTRACT_SQL},
arms AS (SELECT *, CASE WHEN user_id % 7 = 0 THEN 'holdout' ELSE variant END AS arm FROM xt),
pooled AS (SELECT regr_slope(avg_value, pre_value) AS theta, avg(pre_value) AS mx, count(*) AS n_users FROM arms),
adj AS (SELECT arm, avg_value, avg_value - theta * (pre_value - mx) AS y FROM arms, pooled)
SELECT 'ok' AS status, (SELECT n_users FROM pooled) AS n_users,
       avg(avg_value) FILTER (arm = 'treatment') - avg(avg_value) FILTER (arm = 'control') AS raw_ate,
       avg(y) FILTER (arm = 'treatment') - avg(y) FILTER (arm = 'control') AS cuped_ate,
       (SELECT theta FROM pooled) AS theta, (1 - var_samp(y) / var_samp(avg_value)) * 100 AS variance_reduction_pct
FROM adj""", "raw_ate cuped_ate theta variance_reduction_pct")
def cuped(spark, sf_dir):
    three_arms = extract(spark, sf_dir).withColumn(
        "variant", F.when(F.col("user_id") % 7 == 0, "holdout").otherwise(F.col("variant")))
    return abtest.cuped(moments.joint_moments(plan.experiment_cells(three_arms, demo.SPEC)))


@query("segment_effects", "D5 D16 E9", f"""WITH {demo.EXTRACT_SQL},
seg AS (SELECT *, 'platform=' || platform || ',user_segment=' || user_segment AS segment FROM xt WHERE avg_value IS NOT NULL),
arms AS ({arms_sql('avg_value', 'segment', 'seg')}),
test AS (SELECT segment, {WELCH_COLUMNS} FROM arms WHERE n_control >= 8 AND n_treatment >= 8),
p AS (SELECT *, {TWO_SIDED} AS p_value, count(*) OVER () AS n_tests FROM test)
SELECT 'avg_value' AS metric, segment, mean_diff AS effect_size,
       (n_control + n_treatment) / (SELECT count(*) FROM seg)::DOUBLE AS segment_share, control_mean, treatment_mean, t_stat, dof,
       p_value, p_value < 0.05 / n_tests AS significant, n_control, n_treatment, n_tests
FROM p""", "effect_size segment_share control_mean treatment_mean t_stat dof p_value")
def segment_effects(spark, sf_dir):
    segs = moments.segment_moments(cells(spark, sf_dir), list(demo.SPEC.segment_cols), ["avg_value"])
    return abtest.heterogeneous_effects(segs, min_segment_size=8)


@query("top_segment", "D16 E9", f"""WITH {demo.EXTRACT_SQL},
long AS (SELECT 'avg_value' AS metric, avg_value AS y, * FROM xt UNION ALL SELECT 'error_rate', error_rate, * FROM xt),
seg AS (SELECT *, 'platform=' || platform || ',user_segment=' || user_segment AS segment FROM long WHERE y IS NOT NULL),
arms AS ({arms_sql('y', 'metric, segment', 'seg')}),
test AS (SELECT metric, segment, {WELCH_COLUMNS} FROM arms WHERE n_control >= 8 AND n_treatment >= 8 AND v_c + v_t > 0),
p AS (SELECT *, {TWO_SIDED} AS p_value, count(*) OVER (PARTITION BY metric) AS n_tests FROM test),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY (p_value < 0.05 / n_tests) DESC, abs(mean_diff) DESC, segment) AS rank FROM p)
SELECT metric, segment, mean_diff AS effect_size, (n_control + n_treatment) / (SELECT count(*) FROM xt)::DOUBLE AS segment_share, p_value,
       p_value < 0.05 / n_tests AS significant FROM r WHERE rank = 1""", "effect_size segment_share p_value")
def top_segment(spark, sf_dir):
    segs = moments.segment_moments(cells(spark, sf_dir), list(demo.SPEC.segment_cols), ["avg_value", "error_rate"])
    return abtest.top_segments(abtest.heterogeneous_effects(segs, min_segment_size=8))


_INTERACTION = f"""WITH {demo.EXTRACT_SQL},
long AS (SELECT 'platform' AS segment_col, platform AS lev, * FROM xt UNION ALL SELECT 'user_segment', user_segment, * FROM xt),
c AS (SELECT segment_col, lev, variant = 'treatment' AS tr, count(*) AS n, avg(avg_value) AS m,
        count(*) * var_pop(avg_value) AS ss FROM long WHERE avg_value IS NOT NULL GROUP BY ALL),
lv AS (SELECT segment_col, lev, sum(n) AS n, sum(ss) AS ss,
         sum(n) FILTER (tr) * sum(n) FILTER (NOT tr) / (sum(n))::DOUBLE AS w,
         sum(m) FILTER (tr) - sum(m) FILTER (NOT tr) AS d FROM c GROUP BY ALL),
b AS (SELECT segment_col, sum(w * d) / sum(w) AS b FROM lv GROUP BY ALL),
t AS (SELECT segment_col, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_levels, sum(ss) AS ss_full, sum(w * (d - b) ** 2) AS ss_extra
      FROM lv JOIN b USING (segment_col) GROUP BY ALL)
SELECT 'avg_value' AS metric, *, (ss_extra / (n_levels - 1)) / (ss_full / (n - 2 * n_levels)) AS f_stat,
       {demo.f_upper_sql('((ss_extra / (n_levels - 1)) / (ss_full / (n - 2 * n_levels)))', '(n_levels - 1)', '(n - 2 * n_levels)')} AS p_value
FROM t"""


@query("segment_interaction", "D17", _INTERACTION, "f_stat p_value", {"ss_full": 3, "ss_extra": 3})
def segment_interaction(spark, sf_dir):
    level_cells = abtest.interaction_cells(cells(spark, sf_dir), list(demo.SPEC.segment_cols), ["avg_value"])
    return abtest.interaction_test(level_cells)


@query("smallest_interaction", "D16 D17", f"SELECT metric, arg_min(segment_col, p_value) AS segment_col, min(p_value) AS interaction_p_value FROM ({_INTERACTION}) GROUP BY metric", "interaction_p_value")
def smallest_interaction(spark, sf_dir):
    """From the segment result, which carries it on every row."""
    c = cells(spark, sf_dir)
    tests = abtest.interaction_test(abtest.interaction_cells(c, list(demo.SPEC.segment_cols), ["avg_value"]))
    effects = abtest.heterogeneous_effects(moments.segment_moments(c, list(demo.SPEC.segment_cols), ["avg_value"]), min_segment_size=2, interactions=tests)
    return abtest.smallest_interaction(tests).drop("interaction_p_value").join(effects.select("metric", "interaction_p_value").distinct(), "metric")


@query("sample_ratio", "D18", f"""WITH {demo.EXTRACT_SQL},
n AS (SELECT count(avg_value) FILTER (variant = 'control') AS n_control, count(avg_value) FILTER (variant = 'treatment') AS n_treatment FROM xt),
c AS (SELECT *, pow(n_control - 0.5 * (n_control + n_treatment), 2) / (0.5 * (n_control + n_treatment))
      + pow(n_treatment - 0.5 * (n_control + n_treatment), 2) / (0.5 * (n_control + n_treatment)) AS chi2 FROM n)
SELECT 'avg_value' AS metric, n_control, n_treatment, 0.5 AS expected_ratio, chi2,
       n_control / (n_control + n_treatment) AS observed_ratio, {demo.normal_two_sided_sql('sqrt(chi2)')} AS p_value,
       {demo.normal_two_sided_sql('sqrt(chi2)')} < 0.001 AS srm_detected FROM c""",
       "expected_ratio chi2 observed_ratio p_value")
def sample_ratio(spark, sf_dir):
    return abtest.sample_ratio(moments.long_moments(cells(spark, sf_dir), ["variant"], ["avg_value"]), ["metric"])


@query("novelty", "B8 D6 D19", f"""WITH {demo.EXTRACT_SQL},
long AS (SELECT 'avg_value' AS metric, avg_value AS y, week, variant FROM xt UNION ALL SELECT 'error_rate', error_rate, week, variant FROM xt
         UNION ALL SELECT 'click_share', click_share, week, variant FROM xt),
a AS (SELECT metric, avg(y) FILTER (week = 1 AND variant = 'treatment') - avg(y) FILTER (week = 1 AND variant = 'control') AS week1_ate,
        avg(y) FILTER (week = 2 AND variant = 'treatment') - avg(y) FILTER (week = 2 AND variant = 'control') AS week2_ate
      FROM long GROUP BY metric),
d AS (SELECT metric, 'ok' AS status, week1_ate, week2_ate,
  CASE WHEN week1_ate = 0 AND week2_ate = 0 THEN 'stable'
       WHEN week1_ate = 0 THEN CASE WHEN week2_ate > 0 THEN 'growing' ELSE 'decaying' END
       WHEN abs(week2_ate) > abs(week1_ate) * 1.10 THEN 'growing'
       WHEN abs(week2_ate) < abs(week1_ate) * 0.90 THEN 'decaying'
       WHEN (week1_ate > 0) <> (week2_ate > 0) THEN 'decaying' ELSE 'stable' END AS effect_direction FROM a)
SELECT *, effect_direction = 'decaying' AND abs(week1_ate) > 0 AND (abs(week2_ate) < 0.5 * abs(week1_ate)
       OR (abs(week2_ate) > 0 AND (week1_ate > 0) <> (week2_ate > 0))) AS novelty_likely FROM d""", "week1_ate week2_ate")
def novelty(spark, sf_dir):
    labelled = extract(spark, sf_dir).withColumn(
        "week", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("W"), F.col("week"))).otherwise(F.concat(F.lit("week_"), F.col("week"))))
    return abtest.novelty(moments.week_moments(plan.experiment_cells(labelled, demo.SPEC), ["avg_value", "error_rate", "click_share"]))


@query("guardrails", "B12 D4 D20", f"""WITH {demo.EXTRACT_SQL},
arms AS (SELECT 'error_rate' AS metric, * FROM ({arms_sql('error_rate')}) UNION ALL SELECT 'click_share', * FROM ({arms_sql('click_share')})),
test AS (SELECT metric, {WELCH_COLUMNS} FROM arms),
p AS (SELECT *, {TWO_SIDED} AS p_value, count(*) OVER () AS n_tests, CASE metric WHEN 'error_rate' THEN 'increase' ELSE 'decrease' END AS direction FROM test)
SELECT metric, direction, control_mean, treatment_mean, mean_diff / abs(control_mean) * 100 AS delta_pct, t_stat, dof, p_value, n_tests,
       p_value < 0.05 / n_tests AND (CASE direction WHEN 'increase' THEN treatment_mean > control_mean ELSE treatment_mean < control_mean END) AS breached
FROM p""", "control_mean treatment_mean delta_pct t_stat dof p_value")
def guardrails(spark, sf_dir):
    long = moments.long_moments(cells(spark, sf_dir), ["variant"], list(demo.SPEC.guardrail_metrics))
    return abtest.guardrails(long, default_direction=demo.SPEC.default_harm_direction)


Z = "(1.959963984540054 + 0.8416212335729143)"


@query("detectable_effect", "D21 D25", f"""WITH {demo.EXTRACT_SQL},
arms AS ({arms_sql('avg_value')}),
m AS (SELECT *, {Z} * sqrt(v_c) * sqrt(1 / n_control + 1 / n_treatment) AS mde_absolute FROM arms)
SELECT 'avg_value' AS metric, n_control, n_treatment, mde_absolute, mde_absolute / abs(m_c) * 100 AS mde_relative_pct,
       abs(m_t - m_c) >= mde_absolute AS is_powered, 500000 * mde_absolute / abs(m_c) * 0.5 AS daily_value,
       'At MDE of ' || format('{{:.1f}}', mde_absolute / abs(m_c) * 100) || '%, detects a avg_value lift worth ~$'
       || CASE WHEN 500000 * mde_absolute / abs(m_c) * 0.5 >= 1000 THEN format('{{:.0f}}', 500000 * mde_absolute / abs(m_c) * 0.5 / 1000) || 'k'
          ELSE format('{{:.0f}}', 500000 * mde_absolute / abs(m_c) * 0.5) END || '/day at current scale.' AS impact
FROM m""", "mde_absolute mde_relative_pct", {"daily_value": 4})
def detectable_effect(spark, sf_dir):
    tests = abtest.welch_test(moments.long_moments(cells(spark, sf_dir), ["variant"], ["avg_value"]), ["metric"])
    mde = abtest.detectable_effect(tests)
    out = abtest.business_impact(mde, "avg_value", demo.SPEC.baseline_unit_count, demo.SPEC.revenue_per_unit)
    return out.select("metric", "n_control", "n_treatment", "mde_absolute", "mde_relative_pct", "is_powered", "daily_value", "impact")


def _nct_sql(t: str) -> str:
    """Non-central t probability: the normal probability at ``t * s - ncp`` averaged over the scale ``s``."""
    s = "(lo + (hi - lo) * i / 400)"
    simpson = lambda v, n: f"(CASE WHEN {v} = 0 OR {v} = {n} THEN 1 WHEN {v} % 2 = 1 THEN 4 ELSE 2 END)::DOUBLE"
    density = f"exp((dof - 1) * ln({s}) - dof * ({s} * {s} - 1) / 2)"
    z = f"({t} * {s} - ncp)"
    area = f"list_sum(list_transform(generate_series(0, 200), lambda j: {simpson('j', 200)} * exp(-pow({z} * j / 200, 2) / 2))) * {z} / 600"
    top = f"list_sum(list_transform(generate_series(0, 400), lambda i: {simpson('i', 400)} * {density} * (0.5 + {area} / sqrt(2 * pi()))))"
    return f"({top} / list_sum(list_transform(generate_series(0, 400), lambda i: {simpson('i', 400)} * {density})))"


@query("post_hoc_power", "D22 G1", f"""WITH RECURSIVE {demo.EXTRACT_SQL},
arms AS (SELECT 'avg_value' AS metric, * FROM ({arms_sql('avg_value')}) UNION ALL SELECT 'error_rate', * FROM ({arms_sql('error_rate')})
  UNION ALL SELECT 'click_share', * FROM ({arms_sql('click_share')})),
p AS (SELECT metric, n_control, n_treatment, (n_control + n_treatment - 2)::DOUBLE AS dof,
        abs(m_t - m_c) / (sqrt(v_c) * sqrt(1 / n_control + 1 / n_treatment)) AS ncp FROM arms),
crit AS (
  SELECT DISTINCT dof, 0.0::DOUBLE AS low, 50.0::DOUBLE AS high, 0 AS step FROM p
  UNION ALL
  SELECT dof, CASE WHEN {demo.t_two_sided_sql('(low + high) / 2', 'dof')} > 0.05 THEN (low + high) / 2 ELSE low END,
         CASE WHEN {demo.t_two_sided_sql('(low + high) / 2', 'dof')} > 0.05 THEN high ELSE (low + high) / 2 END, step + 1
  FROM crit WHERE step < 50),
c AS (SELECT p.*, high AS tc, greatest(1e-12, 1 - 12 / sqrt(2 * dof)) AS lo, 1 + 12 / sqrt(2 * dof) AS hi FROM p JOIN (SELECT dof, high FROM crit WHERE step = 50) USING (dof))
SELECT metric, n_control, n_treatment, ncp, 1 - {_nct_sql('tc')} + {_nct_sql('(-tc)')} AS post_hoc_power FROM c""", "ncp", {"post_hoc_power": 4})
def post_hoc_power(spark, sf_dir):
    long = moments.long_moments(cells(spark, sf_dir), ["variant"], ["avg_value", "error_rate", "click_share"])
    mde = abtest.detectable_effect(abtest.welch_test(long, ["metric"]))
    return mde.select("metric", "n_control", "n_treatment", "ncp", "post_hoc_power")


@query("power_table", "D23 D24", f"""WITH b AS (
  SELECT avg(value) AS baseline_mean, stddev_samp(value) AS baseline_std, count(DISTINCT user_id) AS total_users,
         count(DISTINCT CAST(ts AS DATE)) AS total_days FROM events),
t AS (SELECT *, total_users / greatest(total_days, 1) AS daily_traffic FROM b),
r AS (SELECT t.*, l.mde_pct, abs(baseline_mean) * l.mde_pct / 100 AS mde_absolute,
        CAST(ceil(2 * pow({Z} * baseline_std / (abs(baseline_mean) * l.mde_pct / 100), 2)) AS BIGINT) AS n_per_arm
      FROM t, (VALUES (1.0::DOUBLE), (2), (3), (5), (7), (10), (15), (20)) l(mde_pct))
SELECT *, CAST(2 * n_per_arm AS BIGINT) AS total_n,
       greatest(CAST(ceil(2 * n_per_arm / greatest(daily_traffic, 1)) AS BIGINT), 1) AS runtime_days FROM r""",
       "baseline_mean baseline_std daily_traffic mde_pct mde_absolute")
def power_table(spark, sf_dir):
    return abtest.power_table(demo.events(spark, sf_dir), "value", "user_id", "date")


@query("median_by_group", "D49", """SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS median_value,
  quantile_cont(value, 0.9) AS p90_value FROM events GROUP BY event_type""", "median_value p90_value")
def median_by_group(spark, sf_dir):
    q = quantiles.quantiles(demo.events(spark, sf_dir), "value", [0.5, 0.9], ["event_type"])
    return q.select("event_type", "n", F.col("quantiles")[0].alias("median_value"), F.col("quantiles")[1].alias("p90_value"))


@query("quantiles_by_histogram", "D49 B10", """SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.01) AS p01,
  quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.99) AS p99 FROM orders GROUP BY 1""", "p01 p50 p99")
def quantiles_by_histogram(spark, sf_dir):
    from gaugeline.sources.tables import load
    q = quantiles.quantiles(load(spark, sf_dir, "orders"), "o_totalprice", [0.01, 0.5, 0.99], ["o_orderpriority"],
                            distinct_bound=100)
    return q.select("o_orderpriority", "n", *[F.col("quantiles")[i].alias(a) for i, a in enumerate(("p01", "p50", "p99"))])


@query("variant_readout", "C5 D57", f"""WITH {demo.EVENTS_SQL}, {demo.EXPERIMENT_SQL}
SELECT variant, count(DISTINCT e.user_id) AS users, count(*) AS events, sum(value) AS value, CAST(sum(error_rate) AS DOUBLE) AS error_rate
FROM ev e JOIN (SELECT DISTINCT user_id, variant FROM ex) a USING (user_id) GROUP BY variant""", "error_rate", {"value": 3})
def variant_readout(spark, sf_dir):
    return plan.variant_readout(demo.events(spark, sf_dir), demo.experiment(spark, sf_dir), demo.SPEC, ["value", "error_rate"])
