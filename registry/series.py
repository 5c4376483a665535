"""Funnel, growth accounting and time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline.functions.names import week_number
from gaugeline.operators import activity, forecast, funnel, growth, timeseries
from gaugeline.plans import experiment as plan
from gaugeline.sources.tables import load
from registry import demo
from registry.base import query

STEPS = list(demo.FUNNEL_STEPS)
_FX = f"""{demo.FUNNEL_SQL}, {demo.EXPERIMENT_SQL},
fx AS (SELECT user_id, variant, step, max(completed) AS completed FROM fu JOIN (SELECT * FROM ex WHERE week = 1) USING (user_id) GROUP BY ALL)"""


def funnel_rows(spark, sf_dir):
    return plan.funnel_extract(demo.funnel(spark, sf_dir), demo.experiment(spark, sf_dir), demo.SPEC)


@query("funnel_extract", "C4", f"WITH {_FX} SELECT * FROM fx")
def funnel_extract(spark, sf_dir):
    return funnel_rows(spark, sf_dir)


@query("conditional_funnel", "D26", f"""WITH {_FX},
p AS (SELECT user_id, variant, coalesce(max(completed) FILTER (step = 'view'), 0) AS s0, coalesce(max(completed) FILTER (step = 'click'), 0) AS s1,
        coalesce(max(completed) FILTER (step = 'signup'), 0) AS s2, coalesce(max(completed) FILTER (step = 'purchase'), 0) AS s3
      FROM fx GROUP BY ALL),
r AS (SELECT 0 AS step_index, 'view' AS step, variant, s0 AS done FROM p UNION ALL SELECT 1, 'click', variant, s1 FROM p WHERE s0 = 1
      UNION ALL SELECT 2, 'signup', variant, s2 FROM p WHERE s1 = 1 UNION ALL SELECT 3, 'purchase', variant, s3 FROM p WHERE s2 = 1),
c AS (SELECT step_index, step, count(*) FILTER (variant = 'control') AS n_control, count(*) FILTER (variant = 'treatment') AS n_treatment,
        avg(done) FILTER (variant = 'control') AS control_rate, avg(done) FILTER (variant = 'treatment') AS treatment_rate, avg(done) AS pool
      FROM r GROUP BY ALL),
z AS (SELECT *, treatment_rate - control_rate AS delta, sqrt(pool * (1 - pool) * (1 / n_control + 1 / n_treatment)) AS se FROM c)
SELECT step_index, step, 'ok' AS status, n_control, n_treatment, control_rate, treatment_rate, delta, delta / control_rate * 100 AS pct_change,
       CASE WHEN se = 0 THEN 0.0::DOUBLE ELSE delta / se END AS z_stat,
       CASE WHEN se = 0 THEN 1.0::DOUBLE ELSE {demo.normal_two_sided_sql('(delta / se)')} END AS p_value,
       CASE WHEN se = 0 THEN false ELSE {demo.normal_two_sided_sql('(delta / se)')} < 0.05 END AS significant,
       row_number() OVER (ORDER BY abs(delta) DESC, step_index) = 1 AS biggest_dropoff
FROM z""", "control_rate treatment_rate delta pct_change z_stat p_value")
def conditional_funnel(spark, sf_dir):
    rows = funnel_rows(spark, sf_dir)
    return funnel.conditional_funnel(rows, STEPS)


@query("funnel_for_segment", "B5 D26", f"""WITH {demo.EVENTS_SQL}, {demo.EXPERIMENT_SQL},
r AS (SELECT user_id, variant, event_type AS step, max((value >= 20)::INT) AS completed FROM ev JOIN (SELECT * FROM ex WHERE week = 1) USING (user_id)
      WHERE platform = 'android' AND event_type IN ('view', 'click') GROUP BY ALL),
p AS (SELECT user_id, variant, coalesce(max(completed) FILTER (step = 'view'), 0) AS s0, coalesce(max(completed) FILTER (step = 'click'), 0) AS s1 FROM r GROUP BY ALL)
SELECT variant, 0 AS step_index, 'view' AS step, count(*) AS eligible, CAST(sum(s0) AS BIGINT) AS completed FROM p GROUP BY variant
UNION ALL SELECT variant, 1, 'click', count(*), CAST(sum(s1) AS BIGINT) FROM p WHERE s0 = 1 GROUP BY variant""")
def funnel_for_segment(spark, sf_dir):
    android = plan.where_equal(demo.events(spark, sf_dir), {"platform": "android"})
    steps = android.where(F.col("event_type").isin("view", "click")).select(
        "user_id", F.col("event_type").alias("step"), (F.col("value") >= 20).alias("completed"))
    rows = plan.funnel_extract(steps, demo.experiment(spark, sf_dir), demo.SPEC)
    return funnel.arm_steps(rows, ["view", "click"])


@query("week_labels", "B8", """SELECT week_label, week, count(*) AS n FROM (
  SELECT CASE user_id % 5 WHEN 0 THEN 'W' || w WHEN 1 THEN 'week_' || w WHEN 2 THEN ' week' || w WHEN 3 THEN w || '.0' ELSE 'n/a' END AS week_label,
         CASE WHEN user_id % 5 < 4 THEN w END AS week
  FROM (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 + 1 AS INTEGER) AS w FROM events)) GROUP BY ALL""")
def week_labels(spark, sf_dir):
    w = (F.floor(F.date_diff(F.col("date"), F.lit("2024-01-01").cast("date")) / 7) + 1).cast("int").cast("string")
    u = F.col("user_id") % 5
    label = F.when(u == 0, F.concat(F.lit("W"), w)).when(u == 1, F.concat(F.lit("week_"), w)) \
        .when(u == 2, F.concat(F.lit(" week"), w)).when(u == 3, F.concat(w, F.lit(".0"))).otherwise("n/a")
    labelled = demo.events(spark, sf_dir).select(label.alias("week_label"))
    return labelled.groupBy("week_label").agg(F.count(F.lit(1)).alias("n")).withColumn("week", week_number(F.col("week_label")))


def _growth_sql(window: int) -> str:
    return f"""WITH {demo.EVENTS_SQL},
d AS (SELECT DISTINCT user_id, date, platform, user_segment FROM ev), first AS (SELECT user_id, min(date) AS inst FROM d GROUP BY user_id),
grid AS (SELECT * FROM (SELECT DISTINCT date FROM ev), (SELECT DISTINCT platform, user_segment FROM ev)),
t AS (SELECT d.*, date_diff('day', inst, date) < 7 AS is_new,
        EXISTS (SELECT 1 FROM d p WHERE p.user_id = d.user_id AND p.date < d.date AND p.date >= d.date - {window}) AS in_prior,
        EXISTS (SELECT 1 FROM d p WHERE p.user_id = d.user_id AND p.date < d.date - {window}) AS in_older
      FROM d JOIN first USING (user_id)),
a AS (SELECT date, platform, user_segment, count(*) AS dau, count(*) FILTER (is_new) AS nu, count(*) FILTER (in_prior) AS re,
        count(*) FILTER (NOT in_prior AND in_older) AS rs FROM t GROUP BY ALL),
c AS (SELECT date + {window} AS date, platform, user_segment, count(*) AS ch FROM d
      WHERE NOT EXISTS (SELECT 1 FROM d n WHERE n.user_id = d.user_id AND n.date = d.date + {window}) GROUP BY ALL),
m AS (SELECT date, platform, user_segment, avg(value) AS av, avg(error_rate) AS ae FROM ev GROUP BY ALL)
SELECT CAST(grid.date AS VARCHAR) AS date, platform, user_segment, coalesce(dau, 0) AS dau, coalesce(nu, 0) AS new_users, coalesce(re, 0) AS retained_users,
       coalesce(rs, 0) AS resurrected_users, coalesce(ch, 0) AS churned_users, coalesce(av, 0) AS avg_value, coalesce(ae, 0) AS avg_error_rate
FROM grid LEFT JOIN a USING (date, platform, user_segment) LEFT JOIN c USING (date, platform, user_segment) LEFT JOIN m USING (date, platform, user_segment)"""


def metrics_daily(spark, sf_dir, window=28):
    return growth.growth_accounting(demo.events(spark, sf_dir), ["platform", "user_segment"], rates=["value", "error_rate"],
                                    window_days=window)


@query("growth_accounting", "D32 E8 C15 U1", _growth_sql(28), "avg_value avg_error_rate")
def growth_accounting(spark, sf_dir):
    return metrics_daily(spark, sf_dir).withColumn("date", F.col("date").cast("string"))


@query("growth_accounting_short_window", "D32 E8 C15", _growth_sql(3), "avg_value avg_error_rate")
def growth_accounting_short_window(spark, sf_dir):
    return metrics_daily(spark, sf_dir, 3).withColumn("date", F.col("date").cast("string"))


@query("growth_accounting_bitmaps", "D32 E8 C15 U1", _growth_sql(28), "avg_value avg_error_rate")
def growth_accounting_bitmaps(spark, sf_dir):
    out = activity.growth_accounting(demo.events(spark, sf_dir), ["platform", "user_segment"], rates=["value", "error_rate"])
    return out.withColumn("date", F.col("date").cast("string"))


@query("reach_between_dates", "C15 U1", "SELECT count(DISTINCT user_id) AS reach FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'")
def reach_between_dates(spark, sf_dir):
    return activity.reach(activity.day_bitmaps(demo.events(spark, sf_dir), "user_id", "date"), "2024-01-05", "2024-01-06")


@query("active_user_sets", "C15 U1", """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events),
today AS (SELECT user_id FROM d WHERE date = DATE '2024-01-20'), prior AS (SELECT DISTINCT user_id FROM d WHERE date < DATE '2024-01-20' AND date >= DATE '2024-01-20' - 2),
older AS (SELECT DISTINCT user_id FROM d WHERE date < DATE '2024-01-20' - 2), exactly AS (SELECT user_id FROM d WHERE date = DATE '2024-01-20' - 2)
SELECT user_id, 'today' AS set FROM today UNION ALL SELECT user_id, 'retained' FROM (SELECT * FROM today INTERSECT SELECT * FROM prior)
UNION ALL SELECT user_id, 'returning' FROM ((SELECT * FROM today EXCEPT SELECT * FROM prior) INTERSECT SELECT * FROM older)
UNION ALL SELECT user_id, 'lost' FROM (SELECT * FROM exactly EXCEPT SELECT * FROM today)
UNION ALL SELECT user_id, 'reach' FROM (SELECT * FROM today UNION SELECT * FROM prior)""")
def active_user_sets(spark, sf_dir):
    return growth.active_user_sets(demo.events(spark, sf_dir), "user_id", "date", "2024-01-20", window_days=2)


@query("daily_metric", "D27 D46", f"""WITH {demo.EVENTS_SQL}
SELECT CAST(date AS VARCHAR) AS date, platform, avg(value) AS value FROM ev GROUP BY ALL""", "value")
def daily_metric(spark, sf_dir):
    return growth.daily_metric(demo.events(spark, sf_dir), "date", "value", "mean", ["platform"]).withColumn("date", F.col("date").cast("string"))


@query("daily_rollup", "D28", f"""WITH m AS ({_growth_sql(3)})
SELECT date, platform, CAST(sum(dau) AS BIGINT) AS dau, CAST(sum(new_users) AS BIGINT) AS new_users, CAST(sum(retained_users) AS BIGINT) AS retained_users,
       CAST(sum(resurrected_users) AS BIGINT) AS resurrected_users, CAST(sum(churned_users) AS BIGINT) AS churned_users FROM m GROUP BY ALL""")
def daily_rollup(spark, sf_dir):
    return growth.daily_rollup(metrics_daily(spark, sf_dir, 3), "date", ["platform"]).withColumn("date", F.col("date").cast("string"))


@query("component_changes", "D29 E4", f"""WITH m AS ({_growth_sql(3)}),
s AS (SELECT date, sum(dau) AS dau, sum(new_users) AS new, sum(retained_users) AS retained, sum(resurrected_users) AS resurrected, sum(churned_users) AS churned FROM m GROUP BY date),
n AS (SELECT *, row_number() OVER (ORDER BY date) <= 21 AS base FROM s),
l AS (SELECT 0 AS i, 'new' AS component, new AS v, base, dau FROM n UNION ALL SELECT 1, 'retained', retained, base, dau FROM n
      UNION ALL SELECT 2, 'resurrected', resurrected, base, dau FROM n UNION ALL SELECT 3, 'churned', churned, base, dau FROM n),
g AS (SELECT i, component, avg(v) FILTER (base) AS baseline_avg, avg(v) FILTER (NOT base) AS recent_avg, avg(v) / avg(dau) * 100 AS pct_of_dau FROM l GROUP BY ALL),
h AS (SELECT *, recent_avg - baseline_avg AS delta FROM g)
SELECT component, baseline_avg, recent_avg, delta, pct_of_dau,
       row_number() OVER (ORDER BY least(delta, 0), abs(delta) DESC, i) = 1 AS dominant FROM h""", "baseline_avg recent_avg delta pct_of_dau")
def component_changes(spark, sf_dir):
    return growth.component_changes(metrics_daily(spark, sf_dir, 3), window_days=21)


@query("segment_changes", "D30 E3", f"""WITH {demo.EVENTS_SQL}, dt AS (SELECT list_sort(list(DISTINCT date)) AS l FROM ev), sp AS (SELECT l[len(l) // 2 + 1] AS s FROM dt),
l AS (SELECT 'platform' AS segment_col, platform AS segment_value, value, date >= s AS after FROM ev, sp UNION ALL SELECT 'user_segment', user_segment, value, date >= s FROM ev, sp),
g AS (SELECT segment_col, segment_value, avg(value) FILTER (NOT after) AS metric_before, avg(value) FILTER (after) AS metric_after FROM l GROUP BY ALL),
h AS (SELECT *, metric_after - metric_before AS delta FROM g)
SELECT *, abs(delta) / sum(abs(delta)) OVER () * 100 AS contribution_pct,
       row_number() OVER (ORDER BY abs(delta) DESC, segment_col, segment_value) = 1 AS dominant,
       max(delta) OVER () > 0 AND min(delta) OVER () < 0 AND abs(sum(delta) OVER ()) < 0.5 * sum(abs(delta)) OVER () AS cancelling
FROM h""", "metric_before metric_after delta contribution_pct")
def segment_changes(spark, sf_dir):
    return growth.segment_changes(demo.events(spark, sf_dir), "value", ["platform", "user_segment"])


@query("slice_and_dice", "D31 E3", f"""WITH {demo.EVENTS_SQL}, dt AS (SELECT list_sort(list(DISTINCT date)) AS l FROM ev), sp AS (SELECT l[len(l) // 2 + 1] AS s FROM dt),
n AS (SELECT count(DISTINCT date) FILTER (date < s) AS n0, count(DISTINCT date) FILTER (date >= s) AS n1, any_value(s) AS s FROM ev, sp),
l AS (SELECT 'platform' AS dimension, platform AS value_, value, date FROM ev UNION ALL SELECT 'event_type', event_type, value, date FROM ev),
g AS (SELECT dimension, value_ AS value, coalesce(sum(value) FILTER (date >= s), 0) / any_value(n1) - coalesce(sum(value) FILTER (date < s), 0) / any_value(n0) AS delta
      FROM l, n GROUP BY ALL),
t AS (SELECT sum(value) FILTER (date >= s) / any_value(n1) - sum(value) FILTER (date < s) / any_value(n0) AS total FROM ev, n)
SELECT g.*, delta / total * 100 AS contribution_pct FROM g, t""",
       "delta contribution_pct")
def slice_and_dice(spark, sf_dir):
    return growth.slice_and_dice(demo.events(spark, sf_dir), "value", ["platform", "event_type"])


@query("slice_from_given_date", "D31", f"""WITH {demo.EVENTS_SQL}, l AS (SELECT platform AS value_, value, date FROM ev),
g AS (SELECT 'platform' AS dimension, value_ AS value, sum(value) FILTER (date >= DATE '2024-01-20') / 11 - sum(value) FILTER (date < DATE '2024-01-20') / 19 AS delta FROM l GROUP BY ALL)
SELECT *, delta / sum(delta) OVER () * 100 AS contribution_pct FROM g""", "delta contribution_pct")
def slice_from_given_date(spark, sf_dir):
    return growth.slice_and_dice(demo.events(spark, sf_dir), "value", ["platform"], split_at="2024-01-20")


@query("two_level_average", "D33", f"""WITH {demo.EVENTS_SQL}, {demo.EXPERIMENT_SQL},
s AS (SELECT date, variant, platform, sum(value) AS v FROM ev JOIN (SELECT DISTINCT user_id, variant FROM ex) USING (user_id) GROUP BY ALL)
SELECT variant, platform, count(*) AS days, avg(v) AS avg_daily_value FROM s GROUP BY ALL""", "avg_daily_value")
def two_level_average(spark, sf_dir):
    per_user = demo.events(spark, sf_dir).groupBy("user_id", "platform", "date").agg(F.sum("value").alias("value"))
    arms = demo.experiment(spark, sf_dir).select("user_id", "variant").distinct()
    return growth.two_level_average(per_user.join(arms, "user_id"), "date", "value", ["variant", "platform"])


_DAILY = """d AS (SELECT event_type, CAST(ts AS DATE) AS date, sum(value) AS value FROM events GROUP BY ALL)"""
_ANOMALY = f"""WITH {_DAILY},
r AS (SELECT *, count(*) OVER w AS c, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, stddev_samp(value) OVER (PARTITION BY event_type) AS o
      FROM d WINDOW w AS (PARTITION BY event_type ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
z AS (SELECT event_type, date, value, CASE WHEN c >= 7 THEN m END AS rolling_mean,
        coalesce(last_value(CASE WHEN c >= 7 THEN nullif(s, 0) END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY date), nullif(o, 0), 1) AS rolling_std FROM r),
y AS (SELECT *, coalesce((value - rolling_mean) / rolling_std, 0) AS z FROM z),
x AS (SELECT *, max(abs(z)) OVER (PARTITION BY event_type) AS severity FROM y),
f AS (SELECT *, abs(z) > CASE WHEN severity > 2.5 THEN 2.5 ELSE 2.0 END AS anomaly FROM x),
out AS (SELECT *, CASE WHEN avg(z) FILTER (anomaly) OVER (PARTITION BY event_type) < 0 THEN 'drop' ELSE 'spike' END AS direction FROM f)"""


def daily(spark, sf_dir):
    return timeseries.daily_series(demo.events(spark, sf_dir), "value", series=["event_type"])


@query("rolling_anomalies", "E1 E2", f"""{_ANOMALY} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM out""", "value rolling_mean rolling_std z severity")
def rolling_anomalies(spark, sf_dir):
    return timeseries.rolling_anomalies(daily(spark, sf_dir), ["event_type"]).withColumn("date", F.col("date").cast("string"))


@query("anomaly_summary", "E1", f"""{_ANOMALY} SELECT event_type, coalesce(string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (anomaly), '') AS anomaly_dates,
 max(severity) AS severity, any_value(direction) AS direction FROM out GROUP BY event_type""", "severity")
def anomaly_summary(spark, sf_dir):
    return timeseries.anomaly_summary(timeseries.rolling_anomalies(daily(spark, sf_dir), ["event_type"]), ["event_type"])


@query("rolling_forecast", "D43 E4", f"""WITH {_DAILY},
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY date DESC) AS rn FROM d),
f AS (SELECT event_type, avg(value) FILTER (rn BETWEEN 15 AND 21) AS yhat, 2 * stddev_samp(value) FILTER (rn > 14) AS h FROM n GROUP BY event_type)
SELECT event_type, CAST(date AS VARCHAR) AS date, value AS actual, yhat, yhat - h AS yhat_lower, yhat + h AS yhat_upper, CAST(NULL AS VARCHAR) AS warning,
       avg(value) OVER w - yhat AS actual_vs_forecast_delta, bool_or(abs(value - yhat) > h) OVER w AS outside_ci, 'rolling_mean' AS method
FROM n JOIN f USING (event_type) WHERE rn <= 14 WINDOW w AS (PARTITION BY event_type)""", "actual yhat yhat_lower yhat_upper actual_vs_forecast_delta")
def rolling_forecast(spark, sf_dir):
    return timeseries.rolling_forecast(daily(spark, sf_dir), ["event_type"]).withColumn("date", F.col("date").cast("string"))


@query("seasonal_forecast", "D44", f"""WITH {_DAILY},
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY date DESC) > 14 AS train, date_diff('day', DATE '2024-01-01', date)::DOUBLE AS x FROM d),
f AS (SELECT event_type, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM n WHERE train GROUP BY event_type),
t AS (SELECT n.*, a + b * x AS trend FROM n JOIN f USING (event_type)),
s AS (SELECT event_type, dayofweek(date) AS dow, avg(value - trend) AS season FROM t WHERE train GROUP BY ALL),
u AS (SELECT t.*, trend + coalesce(season, 0) AS yhat FROM t LEFT JOIN s ON s.event_type = t.event_type AND s.dow = dayofweek(t.date)),
h AS (SELECT event_type, 1.96 * stddev_samp(value - yhat) AS h FROM u WHERE train GROUP BY event_type)
SELECT event_type, CAST(date AS VARCHAR) AS date, value AS actual, yhat, yhat - h AS yhat_lower, yhat + h AS yhat_upper, CAST(NULL AS VARCHAR) AS warning,
       avg(value) OVER w - avg(yhat) OVER w AS actual_vs_forecast_delta, bool_or(abs(value - yhat) > h) OVER w AS outside_ci, 'weekly_seasonal' AS method
FROM u JOIN h USING (event_type) WHERE NOT train WINDOW w AS (PARTITION BY event_type)""", "actual yhat yhat_lower yhat_upper actual_vs_forecast_delta")
def seasonal_forecast(spark, sf_dir):
    return timeseries.seasonal_forecast(daily(spark, sf_dir), ["event_type"]).withColumn("date", F.col("date").cast("string"))


#: 14 columns: level, slope, five hinges, three sines, three cosines, and the right side; a step clears one column (no pivoting: the matrix is positive definite)
BENDS_SQL = f"""WITH RECURSIVE {_DAILY},
n AS (SELECT event_type, date, value, date_diff('day', DATE '1970-01-01', date) AS day, row_number() OVER s AS i, count(*) OVER (PARTITION BY event_type) AS c FROM d WINDOW s AS (PARTITION BY event_type ORDER BY date)),
tr AS (SELECT * FROM n WHERE i <= c - 14),
sc AS (SELECT event_type, min(day)::DOUBLE AS start, (max(day) - min(day))::DOUBLE AS len, max(abs(value)) AS top, CAST(floor(count(*) * 0.95) AS BIGINT) - 1 AS last, list(day ORDER BY day) AS days FROM tr GROUP BY event_type),
x AS (SELECT n.event_type, date, value, i <= c - 14 AS train, value / top AS v, top,
  [1.0::DOUBLE, (day - start) / len] || list_transform(range(1, 6), lambda j: greatest((day - start) / len - (days[(j * last) // 5 + 1] - start) / len, 0.0))
  || list_transform(range(1, 4), lambda k: sin(2 * pi() * day * k / 7)) || list_transform(range(1, 4), lambda k: cos(2 * pi() * day * k / 7)) AS f
  FROM n JOIN sc USING (event_type)),
cells AS (SELECT event_type, a, b, sum(f[a] * (CASE WHEN b = 14 THEN v ELSE f[b] END)) AS g FROM x, range(1, 14) ra(a), range(1, 15) rb(b) WHERE train GROUP BY ALL),
fixed AS (SELECT event_type, a, list(g + CASE WHEN a <> b THEN 0 WHEN a <= 2 THEN 0.000001 WHEN a <= 7 THEN 0.05 ELSE 0.01 END ORDER BY b) AS r FROM cells GROUP BY event_type, a),
gj(event_type, k, m) AS (SELECT event_type, 1::BIGINT, list(r ORDER BY a) FROM fixed GROUP BY event_type
  UNION ALL SELECT event_type, k + 1, list_transform(range(1, 14), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda y: y / m[k][k]) ELSE list_transform(range(1, 15), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END) FROM gj WHERE k <= 13),
beta AS (SELECT event_type, list_transform(m, lambda r: r[14]) AS b FROM gj WHERE k = 14),
y AS (SELECT event_type, date, value, list_dot_product(f, b) * top AS yhat FROM x JOIN beta USING (event_type) WHERE NOT train)
SELECT event_type, CAST(date AS VARCHAR) AS date, value AS actual, yhat, CAST(NULL AS VARCHAR) AS warning, avg(value) OVER w - avg(yhat) OVER w AS actual_vs_forecast_delta, 'changepoints' AS method, 5 AS bends
FROM y WINDOW w AS (PARTITION BY event_type)"""


@query("changepoint_forecast", "D44", BENDS_SQL, "actual yhat actual_vs_forecast_delta")
def changepoint_forecast(spark, sf_dir):
    """Fixed penalties, so that SQL can solve the same normal equations; bands are simulated and tested apart."""
    out = forecast.changepoint_forecast(daily(spark, sf_dir), ["event_type"], prior=forecast.Prior("ridge", 0.05, 0.01, count=5))
    return out.drop("yhat_lower", "yhat_upper", "outside_ci").withColumn("date", F.col("date").cast("string"))


@query("general_series_anomalies", "B9 B14 B15 D42", """WITH d AS (SELECT date, avg(o_totalprice) AS value FROM (
  SELECT try_cast(CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-01') END AS DATE) AS date, o_totalprice FROM orders)
  WHERE date IS NOT NULL GROUP BY date),
r AS (SELECT *, count(*) OVER w AS c, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
z AS (SELECT CAST(date AS VARCHAR) AS date, value, CASE WHEN c >= 7 THEN coalesce((value - m) / nullif(s, 0), 0) ELSE 0 END AS z FROM r)
SELECT *, abs(z) > CASE WHEN max(abs(z)) OVER () > 2.5 THEN 2.5 ELSE 2.0 END AS anomaly FROM z""", "value z")
def general_series_anomalies(spark, sf_dir):
    month = F.when(F.col("o_orderkey") % 17 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-01"))
    table = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), month.alias("month"), "o_totalprice")
    series = timeseries.general_series(table)
    return timeseries.rolling_anomalies(series).select(F.col("date").cast("date").cast("string").alias("date"), "value", "z", "anomaly")


@query("forward_fill", "E2", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS date, CASE WHEN sum(value) >= 3000 THEN sum(value) END AS value FROM events GROUP BY ALL)
SELECT event_type, CAST(date AS VARCHAR) AS date, last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY date) AS value FROM d""", "", {"value": 4})
def forward_fill(spark, sf_dir):
    gaps = daily(spark, sf_dir).withColumn("value", F.when(F.col("value") >= 3000, F.col("value")))
    return timeseries.forward_fill(gaps, "value", "date", ["event_type"]).withColumn("date", F.col("date").cast("string"))


@query("first_and_last_value", "D58", """SELECT event_type, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value,
 CASE WHEN arg_max(value, ts) > arg_min(value, ts) THEN 'growth' ELSE 'decline' END AS trend FROM events GROUP BY event_type""", "first_value last_value")
def first_and_last_value(spark, sf_dir):
    return timeseries.first_and_last(demo.events(spark, sf_dir), "value", "ts", ["event_type"])
