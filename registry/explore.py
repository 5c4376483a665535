"""Exploration, breakdown, regression, quality and chart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions.names import (default_winsor_pct_col, harm_direction_col, is_rate_metric_col)
from gaugeline.operators import abtest, charts, explore, funnel, moments, quality, regression
from gaugeline.plans import experiment as plan
from gaugeline.sources.tables import load
from registry import demo, experiment as ex
from registry.base import query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def lineitem(spark, sf_dir):
    return load(spark, sf_dir, "lineitem")


_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS null_count, avg({c}) AS mean, stddev_samp({c}) AS std,
 CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS p75,
 CAST(max({c}) AS DOUBLE) AS max, count(DISTINCT {c}) AS n_unique, {i}::INT AS position FROM lineitem"""
    for i, (c, t) in enumerate([(c, "int" if c == "l_linenumber" else "double") for c in NUMBERS]))
_STATS = "min p25 median p75 max"


@query("numeric_summary", "D34 A15", _SUMMARY, _STATS, {"mean": 4, "std": 4})
def numeric_summary(spark, sf_dir):
    return explore.numeric_summary(lineitem(spark, sf_dir), NUMBERS)


@query("numeric_summary_large", "D34", _SUMMARY, _STATS, {"mean": 4, "std": 4})
def numeric_summary_large(spark, sf_dir):
    return explore.numeric_summary(lineitem(spark, sf_dir), NUMBERS, distinct_bound=20)


_COUNTS = """vc AS (SELECT 'o_orderstatus' AS name, o_orderstatus AS value, count(*) AS count, 0 AS position FROM orders GROUP BY ALL
 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), 1 FROM orders GROUP BY ALL)"""


@query("categorical_summary", "D35", f"""WITH {_COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY count DESC, value) AS rn FROM vc)
SELECT name, CAST(sum(count) AS BIGINT) AS non_null, 0::BIGINT AS null_count, count(*) AS n_unique,
       string_agg(value || ': ' || count, ' | ' ORDER BY rn) FILTER (rn <= 5) AS top_values, any_value(position)::INT AS position FROM r GROUP BY name""")
def categorical_summary(spark, sf_dir):
    return explore.categorical_summary(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("trend_rows", "D36 B14", """SELECT o_orderpriority AS priority_level, avg(o_custkey) AS o_custkey, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""",
       "o_custkey", {"o_totalprice": 4})
def trend_rows(spark, sf_dir):
    table = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority_level"), "o_custkey", "o_totalprice")
    return explore.trend_rows(table)


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]]


@query("correlations", "D37 T2 E9", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS correlation, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS overlap FROM lineitem"
    for a, b in _PAIRS) + ") ORDER BY abs(correlation) DESC LIMIT 6", "correlation")
def correlations(spark, sf_dir):
    return explore.correlations(lineitem(spark, sf_dir), 6, NUMBERS)


#: 55 pairs, some with missing values: more than are aggregated side by side
_WIDE = NUMBERS + ["CASE WHEN l_quantity > 10 THEN l_extendedprice END", "CASE WHEN l_linenumber < 4 THEN l_tax END", "l_extendedprice * (1 - l_discount)",
                   "l_quantity * l_quantity", "CASE WHEN l_discount > 0.02 THEN l_quantity + 1000000 END", "CAST(l_orderkey % 97 AS DOUBLE)"]


@query("wide_correlations", "D37", f"WITH w AS (SELECT {', '.join(f'{c} AS w{i}' for i, c in enumerate(_WIDE))} FROM lineitem) SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'w{i}' AS col_a, 'w{j}' AS col_b, corr(w{i}, w{j}) AS correlation, count(*) FILTER (w{i} IS NOT NULL AND w{j} IS NOT NULL) AS overlap FROM w"
    for i in range(len(_WIDE)) for j in range(i + 1, len(_WIDE))) + ")", "correlation")
def wide_correlations(spark, sf_dir):
    table = lineitem(spark, sf_dir).selectExpr(*[f"{c} AS w{i}" for i, c in enumerate(_WIDE)])
    return explore.correlations(table, 1000)


@query("top_rows", "T1 B15", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""", "", {"o_totalprice": 2})
def top_rows(spark, sf_dir):
    return explore.top_rows(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))


@query("breakdown", "D45 D57", """SELECT l_returnflag, l_linestatus, avg(l_quantity) AS avg_l_quantity, avg((l_discount > 0.05)::INT) AS avg_discounted,
 count(*) AS total_records FROM lineitem GROUP BY ALL""", "avg_l_quantity avg_discounted")
def breakdown(spark, sf_dir):
    flagged = lineitem(spark, sf_dir).withColumn("discounted", F.col("l_discount") > 0.05)
    return explore.breakdown(flagged, ["l_returnflag", "l_linestatus"], ["l_quantity", "discounted"], order_by="avg_discounted", worst_first=True)


@query("monthly_trend", "D46", """SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS o_orderdate, sum(o_totalprice) AS sum_o_totalprice FROM orders GROUP BY 1""",
       "", {"sum_o_totalprice": 2})
def monthly_trend(spark, sf_dir):
    out = explore.trend(load(spark, sf_dir, "orders"), "o_orderdate", ["o_totalprice"], "month", "sum")
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))


@query("entity_profile", "D47", """SELECT o_custkey, avg(o_totalprice) AS avg_o_totalprice FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
       "", {"avg_o_totalprice": 4})
def entity_profile(spark, sf_dir):
    return explore.entity_profile(load(spark, sf_dir, "orders"), "o_custkey", ["o_totalprice"], "o_totalprice")


@query("panel_collapse", "D48", """SELECT user_id, CAST(max((event_type = 'error')::INT) AS DOUBLE) AS error_rate, avg(value) AS value FROM events GROUP BY 1""",
       "error_rate value")
def panel_collapse(spark, sf_dir):
    return explore.collapse_panel(demo.events(spark, sf_dir).select("user_id", "error_rate", "value"), "user_id")


@query("age_buckets", "B6", """SELECT CASE WHEN l_quantity <= 25 THEN '18-25' WHEN l_quantity <= 35 THEN '26-35' WHEN l_quantity <= 50 THEN '36-50'
 WHEN l_quantity <= 65 THEN '51-65' ELSE '66+' END AS bucket, count(*) AS n, avg(l_extendedprice) AS mean_price FROM lineitem GROUP BY 1""", "", {"mean_price": 3})
def age_buckets(spark, sf_dir):
    label = explore.bucketed(F.col("l_quantity"), explore.AGE_BOUNDS, explore.AGE_LABELS)
    return lineitem(spark, sf_dir).groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean_price"))


# name, dimension, measure, highest, only positive measures
_DIMS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_tax"]
QUESTIONS = [
    ("which_category_highest_revenue", "l_linenumber", "sum_l_extendedprice", True, False),
    ("which_category_lowest_revenue", "l_linenumber", "sum_l_extendedprice", False, False),
    ("which_category_highest_return_rate", "l_linenumber", "avg_returned", True, False),
    ("which_category_lowest_return_rate", "l_linenumber", "avg_returned", False, False),
    ("which_payment_highest_fraud", "l_quantity", "avg_flagged", True, False),
    ("which_payment_lowest_fraud", "l_quantity", "avg_flagged", False, False),
    ("which_device_highest_fraud", "l_returnflag", "avg_flagged", True, False),
    ("which_device_lowest_fraud", "l_returnflag", "avg_flagged", False, False),
    ("which_tier_highest_avg", "l_tax", "avg_l_extendedprice", True, False),
    ("which_tier_lowest_avg", "l_tax", "avg_l_extendedprice", False, False),
    ("which_tier_only_churned", "l_returnflag", "avg_returned", True, True),
    ("highest_revenue_country", "l_linestatus", "sum_l_extendedprice", True, False),
    ("highest_fraud_country", "l_tax", "avg_flagged", True, False),
    ("group_highest_avg", "l_quantity", "avg_l_extendedprice", True, False),
    ("group_lowest_avg", "l_quantity", "avg_l_extendedprice", False, False),
]
_MEASURE = {"sum_l_extendedprice": "sum(l_extendedprice)", "avg_l_extendedprice": "avg(l_extendedprice)",
            "avg_returned": "avg((l_returnflag = 'R')::INT)", "avg_flagged": "avg((l_discount >= 0.09)::INT)"}


def _flagged(spark, sf_dir):
    return lineitem(spark, sf_dir).withColumns({"returned": (F.col("l_returnflag") == "R").cast("int"),
                                                "flagged": (F.col("l_discount") >= 0.09).cast("int")})


@query("extreme_answers", "D50 T4", " UNION ALL ".join(
    f"""(SELECT '{n}' AS question, CAST({d} AS VARCHAR) AS answer FROM lineitem GROUP BY {d} {'HAVING ' + _MEASURE[m] + ' > 0' if pos else ''}
 ORDER BY {_MEASURE[m]} {'DESC' if hi else 'ASC'}, answer LIMIT 1)""" for n, d, m, hi, pos in QUESTIONS))
def extreme_answers(spark, sf_dir):
    groups = explore.group_metrics(_flagged(spark, sf_dir), _DIMS, ["l_extendedprice", "returned", "flagged"])
    return explore.extreme_answers(groups, QUESTIONS)


@query("shares_and_ranks", "D51", """WITH t AS (SELECT l_linenumber, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)
SELECT l_linenumber, total, total / sum(total) OVER () * 100 AS share_pct, max(total) OVER () - total AS gap_to_leader, max(total) OVER () / total AS leader_ratio,
 row_number() OVER (ORDER BY total DESC) AS rank FROM t""", "share_pct leader_ratio", {"total": 1, "gap_to_leader": 1})
def shares_and_ranks(spark, sf_dir):
    return explore.shares_and_ranks(lineitem(spark, sf_dir), "l_linenumber", "l_extendedprice")


@query("ranked_list", "D51", """SELECT string_agg(CAST(l_linenumber AS VARCHAR), ', ' ORDER BY total DESC) AS ranked
 FROM (SELECT l_linenumber, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)""")
def ranked_list(spark, sf_dir):
    return explore.ranked_list(lineitem(spark, sf_dir), "l_linenumber", "l_extendedprice")


@query("best_group", "D58", """SELECT event_type AS best, avg(value) AS mean FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 1""", "mean")
def best_group(spark, sf_dir):
    return explore.best_group(demo.events(spark, sf_dir), "event_type", "value")


@query("regression", "D39 D40 D41", """WITH c AS (SELECT count(*) AS n, covar_samp(l_quantity, l_quantity) AS aa, covar_samp(l_discount, l_discount) AS bb, covar_samp(l_quantity, l_discount) AS ab,
 covar_samp(l_quantity, l_extendedprice) AS ay, covar_samp(l_discount, l_extendedprice) AS byy, var_samp(l_extendedprice) AS yy FROM lineitem),
d AS (SELECT *, aa * bb - ab * ab AS det FROM c),
b AS (SELECT *, (bb * ay - ab * byy) / det AS b1, (aa * byy - ab * ay) / det AS b2, n - 3 AS dof FROM d),
r AS (SELECT *, (yy - b1 * ay - b2 * byy) * (n - 1) AS rss, 1 - (yy - b1 * ay - b2 * byy) / yy AS r2 FROM b),
s AS (SELECT 'l_quantity' AS feature, b1 AS coefficient, sqrt(bb / det * rss / dof / (n - 1)) AS std_err, aa * bb / det AS vif, * FROM r
 UNION ALL SELECT 'l_discount', b2, sqrt(aa / det * rss / dof / (n - 1)), aa * bb / det, * FROM r)
SELECT 'l_extendedprice' AS target, n AS n_obs, 2 AS n_features, feature, coefficient, std_err, coefficient / std_err AS t_stat, vif, r2 AS r_squared,
 1 - (1 - r2) * (n - 1) / dof AS adj_r_squared, (r2 / 2) / ((1 - r2) / dof) AS f_stat, '' AS collinear_dropped FROM s""",
       "vif r_squared adj_r_squared", {"coefficient": 4, "std_err": 4, "t_stat": 5, "f_stat": 3})
def regression_query(spark, sf_dir):
    table = lineitem(spark, sf_dir).select("l_extendedprice", "l_quantity", "l_discount")
    return regression.regress(table, hint="what drives l extendedprice").drop("p_value", "ci_lower", "ci_upper", "significant", "f_pvalue")


@query("regression_one_category", "D39 D40 D41", """WITH m AS (SELECT quantile_cont(l_tax::DOUBLE, 0.5) AS med FROM lineitem WHERE l_tax > 0),
x AS (SELECT l_extendedprice::DOUBLE AS y, CASE WHEN l_tax > 0 THEN l_tax::DOUBLE ELSE med END AS a, (l_linestatus = 'O')::INT::DOUBLE AS b FROM lineitem, m),
c AS (SELECT count(*) AS n, covar_samp(a, a) AS aa, covar_samp(b, b) AS bb, covar_samp(a, b) AS ab, covar_samp(a, y) AS ay, covar_samp(b, y) AS byy, var_samp(y) AS yy FROM x),
d AS (SELECT *, aa * bb - ab * ab AS det FROM c),
e AS (SELECT *, (bb * ay - ab * byy) / det AS b1, (aa * byy - ab * ay) / det AS b2, n - 3 AS dof FROM d),
r AS (SELECT *, (yy - b1 * ay - b2 * byy) * (n - 1) AS rss, 1 - (yy - b1 * ay - b2 * byy) / yy AS r2 FROM e),
s AS (SELECT 'l_tax' AS feature, b1 AS coefficient, sqrt(bb / det * rss / dof / (n - 1)) AS std_err, aa * bb / det AS vif, * FROM r
 UNION ALL SELECT 'l_linestatus_O', b2, sqrt(aa / det * rss / dof / (n - 1)), aa * bb / det, * FROM r)
SELECT n AS n_obs, feature, coefficient, std_err, vif, r2 AS r_squared FROM s""", "vif r_squared", {"coefficient": 4, "std_err": 4})
def regression_one_category(spark, sf_dir):
    table = lineitem(spark, sf_dir).select("l_extendedprice", F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax"), "l_linestatus")
    return regression.regress(table).select("n_obs", "feature", "coefficient", "std_err", "vif", "r_squared")


# normal equations of the centred columns beside the unit matrix, cleared column by column: the coefficients and the inverse
_FEATURES = {"l_quantity": "l_quantity::DOUBLE", "l_tax": "CASE WHEN l_tax > 0 THEN l_tax::DOUBLE ELSE med END", "l_returnflag_N": "(l_returnflag = 'N')::INT::DOUBLE",
             "l_returnflag_R": "(l_returnflag = 'R')::INT::DOUBLE", "l_linestatus_O": "(l_linestatus = 'O')::INT::DOUBLE"}
_CATEGORIES = f"""WITH RECURSIVE m AS (SELECT quantile_cont(l_tax::DOUBLE, 0.5) AS med FROM lineitem WHERE l_tax > 0),
x AS (SELECT l_extendedprice::DOUBLE AS y, [{", ".join(_FEATURES.values())}] AS f FROM lineitem, m),
a AS (SELECT count(*) AS n, avg(y) AS my, [{", ".join(f"avg(f[{i}])" for i in range(1, 6))}] AS mf FROM x),
z AS (SELECT y - my AS y, [{", ".join(f"f[{i}] - mf[{i}]" for i in range(1, 6))}] AS f FROM x, a),
g AS (SELECT [{", ".join("[" + ", ".join([f"sum(f[{i}] * f[{j}])" for j in range(1, 6)] + [f"sum(f[{i}] * y)"] + [f"{int(i == j)}.0::DOUBLE" for j in range(1, 6)]) + "]" for i in range(1, 6))}] AS m, sum(y * y) AS tss FROM z),
gj(k, m) AS (SELECT 1::BIGINT, m FROM g UNION ALL SELECT k + 1, list_transform(range(1, 6), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
  ELSE list_transform(range(1, 12), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END) FROM gj WHERE k <= 5),
s AS (SELECT gj.m AS s, g.m AS g, tss, tss - list_sum(list_transform(range(1, 6), lambda i: gj.m[i][6] * g.m[i][6])) AS rss, n, n - 6 AS dof FROM gj, g, a WHERE k = 6),
c AS (SELECT dof, 0.0::DOUBLE AS low, 50.0::DOUBLE AS high, 0 AS step FROM s UNION ALL
  SELECT dof, CASE WHEN {demo.t_two_sided_sql('least((low + high) / 2, 12)', 'dof')} > 0.05 THEN (low + high) / 2 ELSE low END,
         CASE WHEN {demo.t_two_sided_sql('least((low + high) / 2, 12)', 'dof')} > 0.05 THEN high ELSE (low + high) / 2 END, step + 1 FROM c WHERE step < 50),
r AS (SELECT i, s[i][6] AS b, sqrt(s[i][6 + i] * rss / s.dof) AS se, s[i][6 + i] * g[i][i] AS vif, 1 - rss / tss AS r2, n, s.dof AS dof, high AS crit FROM s, c, range(1, 6) t(i) WHERE step = 50)
SELECT 'l_extendedprice' AS target, n AS n_obs, 5 AS n_features, [{", ".join(f"'{f}'" for f in _FEATURES)}][i] AS feature, b AS coefficient, se AS std_err, b / se AS t_stat,
 {demo.t_two_sided_sql('least(abs(b / se), 12)', 'dof')} AS p_value, b - crit * se AS ci_lower, b + crit * se AS ci_upper, {demo.t_two_sided_sql('least(abs(b / se), 12)', 'dof')} < 0.05 AS significant,
 vif, r2 AS r_squared, 1 - (1 - r2) * (n - 1) / dof AS adj_r_squared, r2 / 5 / ((1 - r2) / dof) AS f_stat, {demo.f_upper_sql('r2 / 5 / ((1 - r2) / dof)', '5', 'dof')} AS f_pvalue, '' AS collinear_dropped FROM r"""


@query("regression_with_categories", "D38 D39 D40 D41 G1", _CATEGORIES, "p_value vif r_squared adj_r_squared f_pvalue",
       {"coefficient": 3, "std_err": 4, "t_stat": 4, "ci_lower": 3, "ci_upper": 3, "f_stat": 2})
def regression_with_categories(spark, sf_dir):
    table = lineitem(spark, sf_dir).select("l_extendedprice", "l_quantity", F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax"),
                                           "l_returnflag", "l_linestatus")
    return regression.regress(table)


@query("content_checks", "B13 D52", f"""WITH {demo.EXTRACT_SQL},
f AS (SELECT count(*) AS r, count(*) FILTER (variant = 'control') AS nc, count(*) FILTER (variant = 'treatment') AS nt, count(error_rate) AS nm,
 count(*) FILTER (error_rate > 1) AS no, count(DISTINCT user_id) AS ne, count(DISTINCT variant) AS nv, count(DISTINCT week) AS nw FROM xt)
SELECT 'no_rows' AS check, r = 0 AS fired, r::DOUBLE AS measure FROM f UNION ALL SELECT 'too_few_rows', r BETWEEN 1 AND 9, r FROM f
UNION ALL SELECT 'missing_arm', nc = 0 OR nt = 0, nc FROM f UNION ALL SELECT 'arm_imbalance', least(nc, nt) / (nc + nt) < 0.3, least(nc, nt) / (nc + nt) FROM f
UNION ALL SELECT 'percentage_not_rate', no / nm > 0.8, no / nm FROM f UNION ALL SELECT 'join_fan_out', r / (ne * nv * nw) > 3, r / (ne * nv * nw) FROM f""", "measure")
def content_checks(spark, sf_dir):
    return quality.content_checks(ex.extract(spark, sf_dir), "error_rate")


@query("content_checks_general", "D52", """WITH f AS (SELECT count(*) AS r, count(DISTINCT user_id) AS ne FROM events)
SELECT 'no_rows' AS check, r = 0 AS fired, r::DOUBLE AS measure FROM f UNION ALL SELECT 'too_few_rows', r BETWEEN 1 AND 9, r FROM f
UNION ALL SELECT 'join_fan_out', r / ne > 5, r / ne FROM f""", "measure")
def content_checks_general(spark, sf_dir):
    return quality.content_checks(demo.events(spark, sf_dir), "value", mode="general")


def decision_inputs(spark, sf_dir):
    cells = ex.cells(spark, sf_dir)
    metrics = ["avg_value", "error_rate", "click_share"]
    long = moments.long_moments(cells, ["variant"], metrics)
    mde = abtest.detectable_effect(abtest.welch_test(long, ["metric"]))
    srm = abtest.sample_ratio(long, ["metric"]).select("metric", "srm_detected")
    guard = abtest.guardrails(long.where(F.col("metric") != "avg_value")).agg(F.bool_or("breached").alias("b")).scalar()
    return mde.join(srm, "metric").withColumn("any_breached", guard)


_ALL_ARMS = " UNION ALL ".join(f"SELECT '{m}' AS metric, * FROM ({ex.arms_sql(m)})" for m in ("avg_value", "error_rate", "click_share"))
_P_ABOVE = demo.t_two_sided_sql("(low + high) / 2", "dof") + " > 0.05"


@query("decision_table", "D53 D54", f"""WITH RECURSIVE {demo.EXTRACT_SQL},
arms AS ({_ALL_ARMS}),
t0 AS (SELECT metric, {ex.WELCH_COLUMNS} FROM arms),
t1 AS (SELECT *, {ex.TWO_SIDED} AS p_value, (n_control + n_treatment - 2)::DOUBLE AS dof2, sqrt(control_var) * sqrt(1 / n_control + 1 / n_treatment) AS se2 FROM t0),
crit AS (
  SELECT dof, 0.0::DOUBLE AS low, 50.0::DOUBLE AS high, 0 AS step FROM (SELECT dof FROM t1 UNION SELECT dof2 FROM t1)
  UNION ALL
  SELECT dof, CASE WHEN {_P_ABOVE} THEN (low + high) / 2 ELSE low END, CASE WHEN {_P_ABOVE} THEN high ELSE (low + high) / 2 END, step + 1 FROM crit WHERE step < 50),
k AS (SELECT dof, high FROM crit WHERE step = 50),
pw AS (SELECT metric, abs(mean_diff) / se2 AS ncp, dof2 AS dof, k.high AS tc, greatest(1e-12, 1 - 12 / sqrt(2 * dof2)) AS lo, 1 + 12 / sqrt(2 * dof2) AS hi FROM t1 JOIN k ON k.dof = t1.dof2),
po AS (SELECT metric, 1 - {ex._nct_sql('tc')} + {ex._nct_sql('(-tc)')} AS power FROM pw),
g AS (SELECT bool_or(p_value < 0.025 AND CASE metric WHEN 'error_rate' THEN treatment_mean > control_mean ELSE treatment_mean < control_mean END) AS breached FROM t1 WHERE metric <> 'avg_value'),
r AS (SELECT t1.*, power, breached, p_value < 0.05 AS sig, mean_diff - k.high * std_err AS lo, mean_diff + k.high * std_err AS hi, {ex.Z} * se2 AS mde, {ex.Z} * se2 / abs(control_mean) * 100 AS rel,
  pow(n_control - 0.5 * (n_control + n_treatment), 2) / (0.25 * (n_control + n_treatment)) AS chi2, least(n_control, n_treatment) AS have, abs(cohens_d) AS d
  FROM t1 JOIN po USING (metric) JOIN k ON k.dof = t1.dof, g),
f AS (SELECT *, {demo.normal_two_sided_sql('sqrt(chi2)')} < 0.001 AS srm, NOT sig AND abs(mean_diff) < mde AS weak, abs((lo + hi) / 2) > 1e-9 AND hi - lo > 2 * abs((lo + hi) / 2) AS wide,
  CASE WHEN NOT sig AND abs(mean_diff) < mde THEN CAST(floor(have * greatest(pow(rel / 5, 2), 1.5)) AS BIGINT) END AS need FROM r)
SELECT metric, CASE WHEN srm THEN 'stop: fix randomization' WHEN sig AND breached THEN 'roll back' WHEN sig THEN 'investigate before shipping' WHEN weak THEN 'extend: insufficient data' ELSE 'collect more data' END AS action,
 coalesce(need, -1) AS needed_per_arm, coalesce(greatest(need - have, 0), -1) AS shortfall, CASE WHEN d < 0.1 THEN 'negligible' WHEN d < 0.2 THEN 'small' WHEN d < 0.5 THEN 'medium' ELSE 'large' END AS effect_label,
 sig AND power < 0.5 AS winners_curse, weak AS inconclusive, sig AND d < 0.1 AS negligible_effect, wide AS wide_interval, have > 0 AND have < 100 AS small_sample,
 CASE WHEN sig AND p_value < 0.01 AND d >= 0.2 AND NOT wide THEN 'high' WHEN sig THEN 'medium' ELSE 'low' END AS confidence_level,
 CASE WHEN sig AND p_value < 0.01 AND d >= 0.2 AND NOT wide THEN 'robust result' WHEN sig AND d < 0.1 THEN 'significant but negligible effect' WHEN sig AND wide THEN 'significant but the interval is wide relative to the effect'
  WHEN sig AND have < 100 THEN 'significant but small sample' WHEN sig THEN 'significant but borderline p-value' ELSE 'not statistically significant' END AS confidence_reason FROM f""")
def decision_table(spark, sf_dir):
    out = quality.decisions(quality.confidence_level(decision_inputs(spark, sf_dir)))
    return out.select("metric", "action", *[F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("needed_per_arm", "shortfall")], "effect_label",
                      "winners_curse", "inconclusive", "negligible_effect", "wide_interval", "small_sample", "confidence_level", "confidence_reason")


def scored_experiments(spark, sf_dir):
    """Experiment results keyed by part: every flag and size follows from the table's columns."""
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        k.alias("experiment"), (k % 11 == 0).alias("srm_detected"), (k % 3 == 0).alias("significant"), (k % 4 == 0).alias("any_breached"),
        (k % 5 != 0).alias("is_powered"), (F.col("p_size") * 7).cast("bigint").alias("n_control"), (F.col("p_size") * 8).cast("bigint").alias("n_treatment"),
        (F.col("p_retailprice") / 100).alias("mde_relative_pct"), ((F.col("p_retailprice") % 97) / 100).alias("cohens_d"),
        (F.col("p_size") / 10 - 3).alias("ci_lower"), (F.col("p_size") / 10 + 0.5).alias("ci_upper"), ((k % 10) / 10.0).alias("post_hoc_power"),
        ((k % 7) / 100.0).alias("p_value"))


_SCORED = """s AS (SELECT p_partkey AS experiment, p_partkey % 11 = 0 AS srm, p_partkey % 3 = 0 AS sig, p_partkey % 4 = 0 AS br, p_partkey % 5 <> 0 AS pw,
 p_size * 7 AS nc, p_size * 8 AS nt, p_retailprice / 100 AS mde, (p_retailprice % 97) / 100 AS d, p_size / 10 - 3 AS lo, p_size / 10 + 0.5 AS hi, (p_partkey % 10) / 10 AS ph,
 (p_partkey % 7) / 100 AS p FROM part)"""


@query("decision_rules", "D54", f"""WITH {_SCORED},
n AS (SELECT *, CASE WHEN NOT sig AND NOT pw AND nc > 0 AND mde > 0 THEN CAST(floor(nc * greatest((mde / 5) ** 2, 1.5)) AS BIGINT) END AS need FROM s)
SELECT experiment, CASE WHEN srm THEN 'stop: fix randomization' WHEN sig AND br THEN 'roll back' WHEN sig THEN 'investigate before shipping'
 WHEN NOT pw THEN 'extend: insufficient data' ELSE 'collect more data' END AS action, coalesce(need, -1) AS needed_per_arm, coalesce(greatest(need - nc, 0), -1) AS shortfall,
 CASE WHEN d < 0.1 THEN 'negligible' WHEN d < 0.2 THEN 'small' WHEN d < 0.5 THEN 'medium' ELSE 'large' END AS effect_label,
 sig AND ph < 0.5 AS winners_curse, NOT sig AND NOT pw AS inconclusive, sig AND d < 0.1 AS negligible_effect,
 abs((lo + hi) / 2) > 1e-9 AND hi - lo > 2 * abs((lo + hi) / 2) AS wide_interval, nc > 0 AND nc < 100 AS small_sample FROM n""")
def decision_rules(spark, sf_dir):
    out = quality.decisions(scored_experiments(spark, sf_dir))
    return out.select("experiment", "action", *[F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("needed_per_arm", "shortfall")],
                      "effect_label", "winners_curse", "inconclusive", "negligible_effect", "wide_interval", "small_sample")


@query("confidence_levels", "D53", f"""WITH {_SCORED}, w AS (SELECT *, abs((lo + hi) / 2) > 1e-9 AND hi - lo > 2 * abs((lo + hi) / 2) AS wide FROM s)
SELECT experiment, CASE WHEN sig AND p < 0.01 AND d >= 0.2 AND NOT wide THEN 'high' WHEN sig THEN 'medium' ELSE 'low' END AS confidence_level,
 CASE WHEN sig AND p < 0.01 AND d >= 0.2 AND NOT wide THEN 'robust result' WHEN sig AND d < 0.1 THEN 'significant but negligible effect'
  WHEN sig AND wide THEN 'significant but the interval is wide relative to the effect' WHEN sig AND nc < 100 THEN 'significant but small sample'
  WHEN sig THEN 'significant but borderline p-value' ELSE 'not statistically significant' END AS confidence_reason FROM w""")
def confidence_levels(spark, sf_dir):
    return quality.confidence_level(scored_experiments(spark, sf_dir)).select("experiment", "confidence_level", "confidence_reason")


@query("row_count_confidence", "D53", """SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 1000 THEN 'high' WHEN count(*) >= 100 THEN 'medium' ELSE 'low' END AS level FROM events GROUP BY 1""")
def row_count_confidence(spark, sf_dir):
    counts = demo.events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("level", quality.row_count_confidence(F.col("n")))


_GROUP_SCORES = """SELECT event_type AS name, avg((value > 20)::INT) AS score, CAST(sum((value > 20)::INT) AS BIGINT) AS n_pass FROM events WHERE {} GROUP BY 1"""


@query("baseline_comparison", "C16", f"""WITH b AS ({_GROUP_SCORES.format("ts < TIMESTAMP '2024-01-15' AND event_type <> 'error'")}), c AS ({_GROUP_SCORES.format("ts >= TIMESTAMP '2024-01-15' AND event_type <> 'view'")})
SELECT name, b.score AS base_score, c.score AS score, coalesce(b.n_pass, -1) AS base_pass, coalesce(c.n_pass, -1) AS n_pass,
 CASE WHEN c.score IS NULL THEN 'not run' WHEN b.score IS NULL THEN 'no baseline entry' WHEN b.score - c.score > 0.001 THEN 'score dropped'
 WHEN c.n_pass < b.n_pass THEN 'pass count dropped' ELSE 'ok' END AS verdict FROM b FULL OUTER JOIN c USING (name)""", "base_score score")
def baseline_comparison(spark, sf_dir):
    ev = demo.events(spark, sf_dir)
    scored = lambda df: df.groupBy(F.col("event_type").alias("name")).agg(
        F.avg((F.col("value") > 20).cast("int")).alias("score"), F.sum((F.col("value") > 20).cast("int")).alias("n_pass"))
    cut = F.lit("2024-01-15").cast("date")
    out = quality.compare_with_baseline(scored(ev.where((F.col("date") < cut) & (F.col("event_type") != "error"))),
                                        scored(ev.where((F.col("date") >= cut) & (F.col("event_type") != "view"))), 0.001)
    return out.withColumns({c: F.coalesce(c, F.lit(-1)).cast("bigint") for c in ("base_pass", "n_pass")})


@query("correlation_bars", "D55 D56", """SELECT a || ' x ' || b AS pair, r FROM (
 SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem
 UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem) ORDER BY abs(r) DESC LIMIT 8""", "r")
def correlation_bars(spark, sf_dir):
    return charts.correlation_bars(explore.correlations(lineitem(spark, sf_dir), 10, ["l_quantity", "l_extendedprice", "l_tax"]))


@query("missing_bars", "D55", """SELECT 'value' AS "column", count(*) FILTER (event_type = 'error') / count(*) * 100 AS missing_pct FROM events""", "missing_pct")
def missing_bars(spark, sf_dir):
    gaps = demo.events(spark, sf_dir).select("error_rate", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return charts.missing_bars(explore.numeric_summary(gaps, ["error_rate", "value"]))


@query("category_bars", "D55", """SELECT 'o_orderpriority' AS name, o_orderpriority AS category, count(*) AS count FROM orders GROUP BY 2""")
def category_bars(spark, sf_dir):
    columns = ["name", "o_orderpriority", "o_orderstatus"]
    named = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), "o_orderpriority", "o_orderstatus")
    return charts.category_bars(explore.value_counts(named, columns), columns)


@query("spread_series", "D55", """WITH s AS (SELECT min(l_tax) AS a, quantile_cont(l_tax, 0.25) AS b, quantile_cont(l_tax, 0.5) AS c, quantile_cont(l_tax, 0.75) AS d, max(l_tax) AS e FROM lineitem)
SELECT 'l_tax' AS name, e > a AND d > b AND e - a > 5 * (d - b) AS wide_spread, i, percentile, value FROM s,
 LATERAL (VALUES (0, 'Min', a), (1, '25th', b), (2, 'Median', c), (3, '75th', d), (4, 'Max', e)) v(i, percentile, value)""", "value")
def spread_series(spark, sf_dir):
    return charts.spread_series(explore.numeric_summary(lineitem(spark, sf_dir), ["l_quantity", "l_tax"]))


@query("segment_bars", "D56 T2", f"""WITH {demo.EXTRACT_SQL}
SELECT 'platform=' || platform || ',user_segment=' || user_segment AS segment,
 avg(avg_value) FILTER (variant = 'treatment') - avg(avg_value) FILTER (variant = 'control') AS effect FROM xt GROUP BY 1
HAVING count(avg_value) FILTER (variant = 'treatment') >= 2 AND count(avg_value) FILTER (variant = 'control') >= 2 ORDER BY abs(effect) DESC LIMIT 5""", "effect")
def segment_bars(spark, sf_dir):
    segs = moments.segment_moments(ex.cells(spark, sf_dir), list(demo.SPEC.segment_cols), ["avg_value"])
    return charts.segment_bars(abtest.heterogeneous_effects(segs, min_segment_size=2), 5).drop("significant")


@query("experiment_chart_series", "D56", f"""WITH RECURSIVE {demo.EXTRACT_SQL},
arms AS ({ex.arms_sql('avg_value')}),
test AS (SELECT {ex.WELCH_COLUMNS} FROM arms),
crit AS (
  SELECT dof, 0.0::DOUBLE AS low, 50.0::DOUBLE AS high, 0 AS step FROM test
  UNION ALL
  SELECT dof, CASE WHEN {demo.t_two_sided_sql('(low + high) / 2', 'dof')} > 0.05 THEN (low + high) / 2 ELSE low END,
         CASE WHEN {demo.t_two_sided_sql('(low + high) / 2', 'dof')} > 0.05 THEN high ELSE (low + high) / 2 END, step + 1
  FROM crit WHERE step < 50),
th AS (SELECT regr_slope(avg_value, pre_value) AS theta FROM xt),
e AS (SELECT mean_diff - (SELECT theta FROM th) * (avg(pre_value) FILTER (variant = 'treatment') - avg(pre_value) FILTER (variant = 'control')) AS ate FROM xt, test GROUP BY mean_diff)
SELECT 'avg_value' AS metric, w.week, w.effect, e.ate, mean_diff - high * std_err AS ci_lower, mean_diff + high * std_err AS ci_upper,
       {ex.TWO_SIDED} < 0.05 AS significant
FROM test, e, (SELECT high FROM crit WHERE step = 50),
 (SELECT 'Week ' || week AS week, avg(avg_value) FILTER (variant = 'treatment') - avg(avg_value) FILTER (variant = 'control') AS effect FROM xt GROUP BY week) w""",
       "effect ate ci_lower ci_upper")
def experiment_chart_series(spark, sf_dir):
    cells = ex.cells(spark, sf_dir)
    test = abtest.welch_test(moments.long_moments(cells, ["variant"], ["avg_value"]), ["metric"])
    adjusted = abtest.cuped(moments.joint_moments(cells)).withColumn("metric", F.lit("avg_value"))
    bar = charts.effect_bar(test, adjusted)
    weeks = charts.week_bars(abtest.week_effects(moments.week_moments(cells, ["avg_value"])))
    return weeks.join(bar, "metric")


@query("funnel_chart_series", "D56", f"""WITH {demo.FUNNEL_SQL}, {demo.EXPERIMENT_SQL},
p AS (SELECT user_id, any_value(variant) AS variant, max(completed * (step = 'view')::INT) AS s0, max(completed * (step = 'click')::INT) AS s1 FROM fu JOIN (SELECT * FROM ex WHERE week = 1) USING (user_id) GROUP BY user_id)
SELECT 0 AS step_index, 'view' AS step, avg(s0) FILTER (variant = 'control') * 100 AS control_pct, avg(s0) FILTER (variant = 'treatment') * 100 AS treatment_pct FROM p
UNION ALL SELECT 1, 'click', avg(s1) FILTER (variant = 'control') * 100, avg(s1) FILTER (variant = 'treatment') * 100 FROM p WHERE s0 = 1""", "control_pct treatment_pct")
def funnel_chart_series(spark, sf_dir):
    rows = plan.funnel_extract(demo.funnel(spark, sf_dir), demo.experiment(spark, sf_dir), demo.SPEC)
    return charts.funnel_bars(funnel.conditional_funnel(rows, ["view", "click"]))


@query("metric_name_rules", "B11 B12 B13", """WITH w AS (SELECT user_id, event_type || CASE user_id % 4 WHEN 0 THEN '_rate' WHEN 1 THEN '.count' WHEN 2 THEN '/active-users' ELSE '_churned' END AS metric FROM events)
SELECT metric, count(*) AS n, CASE WHEN regexp_matches(metric, '(^|[_\\-./])(error|churn)') AND NOT regexp_matches(metric, '(^|[_\\-./])(click|active)') THEN 'increase'
 WHEN regexp_matches(metric, '(^|[_\\-./])(click|active)') AND NOT regexp_matches(metric, '(^|[_\\-./])(error|churn)') THEN 'decrease' ELSE 'both' END AS direction,
 CASE WHEN metric LIKE '%purchase%' OR metric LIKE '%.count' THEN 0.01 ELSE 0.0 END AS winsor_pct, metric LIKE '%rate%' OR metric LIKE '%churn%' AS is_rate FROM w GROUP BY metric""", "winsor_pct")
def metric_name_rules(spark, sf_dir):
    u = F.col("user_id") % 4
    suffix = F.when(u == 0, "_rate").when(u == 1, ".count").when(u == 2, "/active-users").otherwise("_churned")
    names = demo.events(spark, sf_dir).groupBy(F.concat("event_type", suffix).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return names.withColumns({"direction": harm_direction_col(F.col("metric")), "winsor_pct": default_winsor_pct_col(F.col("metric")),
                              "is_rate": is_rate_metric_col(F.col("metric"))})


@query("plain_sql", "A8 B1", """SELECT c_mktsegment, count(*) AS orders, sum(o_totalprice) AS revenue,
 rank() OVER (ORDER BY sum(o_totalprice) DESC) AS rank FROM customer JOIN orders ON c_custkey = o_custkey
 WHERE o_orderdate >= DATE '1995-01-01' GROUP BY c_mktsegment""", "", {"revenue": 2})
def plain_sql(spark, sf_dir):
    from gaugeline.sources.catalog import run_sql
    from gaugeline.sources.tables import register_views
    register_views(spark, sf_dir, ["customer", "orders"])
    return run_sql(spark, """SELECT c_mktsegment, count(*) AS orders, sum(o_totalprice) AS revenue,
        CAST(rank() OVER (ORDER BY sum(o_totalprice) DESC) AS BIGINT) AS rank
        FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderdate >= DATE '1995-01-01' GROUP BY c_mktsegment""")


@query("demo_questions", "D57", f"""WITH {demo.EVENTS_SQL}, {demo.EXPERIMENT_SQL}, {demo.FUNNEL_SQL}, m AS (SELECT date, platform, count(DISTINCT user_id) AS dau FROM ev GROUP BY ALL)
SELECT 'count_events' AS question, '' AS group_value, count(*)::DOUBLE AS answer FROM ev
UNION ALL SELECT 'variant_counts', variant, count(DISTINCT user_id) FROM ex GROUP BY variant
UNION ALL SELECT 'avg_dau', '', avg(d) FROM (SELECT sum(dau) AS d FROM m GROUP BY date)
UNION ALL SELECT 'dau_by_platform', platform, sum(dau) FROM m GROUP BY platform
UNION ALL SELECT 'share_with_error_by_variant', variant, avg(e) FROM (SELECT user_id, max(error_rate) AS e FROM ev GROUP BY 1) JOIN (SELECT DISTINCT user_id, variant FROM ex) USING (user_id) GROUP BY variant
UNION ALL SELECT 'funnel_steps', step, count(DISTINCT user_id) FILTER (completed = 1) FROM fu GROUP BY step
UNION ALL SELECT 'purchase_rate', '', count(DISTINCT user_id) FILTER (step = 'purchase' AND completed = 1) / count(DISTINCT user_id) FROM fu
UNION ALL SELECT 'users_with_a_click', '', count(DISTINCT user_id) FROM ev WHERE event_type = 'click'
UNION ALL SELECT 'value_by_segment', user_segment, avg(value) FROM ev GROUP BY user_segment
UNION ALL SELECT 'value_by_variant', variant, avg(value) FROM ev JOIN (SELECT DISTINCT user_id, variant FROM ex) USING (user_id) GROUP BY variant
UNION ALL SELECT 'assignments_by_week', CAST(week AS VARCHAR), count(*) FROM ex GROUP BY week
UNION ALL SELECT 'error_rate_by_segment', user_segment, avg(error_rate) FROM ev GROUP BY user_segment
UNION ALL SELECT 'first_seen_by_platform', platform, count(DISTINCT user_id) FROM ev GROUP BY platform""", "answer")
def demo_questions(spark, sf_dir):
    from registry.questions import demo_answers
    return demo_answers(demo.events(spark, sf_dir), demo.experiment(spark, sf_dir), demo.funnel(spark, sf_dir))
