import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import funnel, growth, timeseries


def daily(spark, values, start="2024-01-01"):
    dates = pd.date_range(start, periods=len(values))
    return spark.createDataFrame([(d.date(), float(v)) for d, v in zip(dates, values)], "date date, value double")


def test_drop_is_found(spark):
    rng = np.random.default_rng(0)
    values = 100 + rng.normal(0, 1, 44)
    values[30:] -= 20
    rows = timeseries.anomaly_summary(timeseries.rolling_anomalies(daily(spark, values))).first()
    assert "2024-01-31" in rows["anomaly_dates"] and rows["direction"] == "drop" and rows["severity"] > 2.5


def test_zscores_match_pandas(spark):
    values = list(np.random.default_rng(4).normal(10, 2, 30)) + [7.0] * 20 + [9.0]
    got = timeseries.rolling_anomalies(daily(spark, values)).orderBy("date").toPandas()
    s = pd.Series(values)
    mean, std = s.rolling(14, min_periods=7).mean(), s.rolling(14, min_periods=7).std()
    std = std.where(std > 1e-9).ffill().fillna(s.std())
    z = ((s - mean) / std).fillna(0.0)
    assert got.z.to_numpy() == pytest.approx(z.to_numpy(), abs=1e-6)


def test_flat_series_has_no_anomaly(spark):
    out = timeseries.rolling_anomalies(daily(spark, [5.0] * 20))
    assert out.where("anomaly").count() == 0 and out.first()["direction"] == "spike"


def test_short_series_are_left_out_or_warned(spark):
    assert timeseries.rolling_anomalies(daily(spark, [1, 2])).count() == 0
    row = timeseries.rolling_forecast(daily(spark, [1, 2, 3])).first()
    assert row["warning"] and row["actual_vs_forecast_delta"] == 0.0 and not row["outside_ci"]


def test_forecast_flags_a_break(spark):
    values = list(100 + np.random.default_rng(2).normal(0, 1, 30)) + [50.0] * 14
    row = timeseries.rolling_forecast(daily(spark, values)).first()
    assert row["outside_ci"] and row["actual_vs_forecast_delta"] < -45
    assert timeseries.rolling_forecast(daily(spark, values)).count() == 14


def test_seasonal_forecast_follows_the_week(spark):
    values = [10 + (5 if i % 7 == 0 else 0) + 0.1 * i for i in range(56)]
    out = timeseries.seasonal_forecast(daily(spark, values)).toPandas()
    assert np.abs(out.actual - out.yhat).max() < 0.5


def test_many_series_do_not_mix(spark):
    a = daily(spark, [1.0] * 20).withColumn("k", F.lit("a"))
    b = daily(spark, [float(i) for i in range(20)]).withColumn("k", F.lit("b"))
    both = timeseries.rolling_forecast(a.unionByName(b), ["k"])
    assert {r["k"]: r["yhat"] for r in both.select("k", "yhat").distinct().collect()} == {"a": 1.0, "b": 2.5}  # six training values


def test_general_series_needs_a_time_column(spark):
    assert timeseries.general_series(spark.createDataFrame([("x", 1.0)], "event_date string, v double")) is None
    assert timeseries.general_series(spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "month string, v double")).count() == 2


def funnel_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for u in range(1200):
        arm, seg = ("control", "treatment")[u % 2], ("new", "old")[u % 3 == 0]
        done = True
        for step, p in (("impression", 1.0), ("click", 0.7), ("install", 0.8), ("d1_retain", 0.4 if arm == "treatment" and seg == "new" else 0.6)):
            done = bool(done and rng.random() < p)
            rows.append((u, arm, seg, step, int(done)))
    return spark.createDataFrame(rows, "user_id int, variant string, segment string, step string, completed int")


def test_funnel_finds_the_worst_step(spark):
    df = funnel_rows(spark)
    rows = {r["step"]: r for r in funnel.conditional_funnel(df).collect()}
    assert rows["d1_retain"]["biggest_dropoff"] and rows["d1_retain"]["significant"] and rows["d1_retain"]["delta"] < -0.05
    assert rows["impression"]["control_rate"] == 1.0 and rows["impression"]["p_value"] == 1.0
    new = {r["step"]: r for r in funnel.conditional_funnel(df, segment_filter={"segment": "new"}).collect()}
    assert new["d1_retain"]["delta"] < rows["d1_retain"]["delta"]
    with pytest.raises(ValueError):
        funnel.conditional_funnel(df, segment_filter={"nope": 1})


def test_funnel_accepts_booleans_and_lists_present_steps(spark):
    df = funnel_rows(spark)
    same = funnel.conditional_funnel(df.withColumn("completed", F.col("completed") == 1)).orderBy("step_index").toPandas()
    assert same.treatment_rate.to_numpy() == pytest.approx(funnel.conditional_funnel(df).orderBy("step_index").toPandas().treatment_rate.to_numpy())
    assert funnel.present_steps(df, ["click", "missing", "install"]) == ["click", "install"]


def test_funnel_with_too_few_users(spark):
    df = spark.createDataFrame([(1, "control", "a", 1), (2, "treatment", "a", 1), (3, "treatment", "a", 0)], "user_id int, variant string, step string, completed int")
    assert funnel.conditional_funnel(df, ["a"]).first()["status"] == "too few eligible users"


def test_components(spark):
    n = 44
    rows = [(f"2024-02-{i + 1:02d}" if i < 29 else f"2024-03-{i - 28:02d}", p, 300, 80 if p != "android" or i < 30 else 20, 200, 10, 12) for i in range(n) for p in ("ios", "android")]
    df = spark.createDataFrame(rows, "date string, platform string, dau int, new_users int, retained_users int, resurrected_users int, churned_users int").withColumn("date", F.to_date("date"))
    rows = {r["component"]: r for r in growth.component_changes(df).collect()}
    assert rows["new"]["dominant"] and rows["new"]["delta"] < 0 and not rows["churned"]["dominant"]


def test_growth_against_sets(spark):
    rng = np.random.default_rng(9)
    seen = sorted({(int(u), int(d)) for u, d in zip(rng.integers(0, 30, 300), rng.integers(0, 60, 300))})
    base = pd.Timestamp("2024-01-01")
    df = spark.createDataFrame([(u, (base + pd.Timedelta(days=d)).date(), "p") for u, d in seen], "user_id int, date date, platform string")
    got = {r["date"]: r for r in growth.growth_accounting(df, ["platform"]).collect()}
    by_day = {}
    for u, d in seen:
        by_day.setdefault(d, set()).add(u)
    for d, today in by_day.items():
        prior = set().union(*[by_day.get(x, set()) for x in range(d - 28, d)])
        older = set().union(*[s for x, s in by_day.items() if x < d - 28] or [set()])
        r = got[(base + pd.Timedelta(days=d)).date()]
        assert (r["dau"], r["retained_users"], r["resurrected_users"], r["churned_users"]) == (
            len(today), len(today & prior), len((today - prior) & older), len(by_day.get(d - 28, set()) - today))


def test_slice_contributions_sum_to_the_whole(spark):
    rows = [(f"2024-01-{d:02d}", p, 10.0 + (5 if p == "android" and d > 5 else 0)) for d in range(1, 11) for p in ("android", "ios")]
    df = spark.createDataFrame(rows, "date string, platform string, dau double")
    out = growth.slice_and_dice(df, "dau", ["platform"]).collect()
    assert out[0]["value"] == "android" and sum(r["contribution_pct"] for r in out) == pytest.approx(100.0)
    flat = growth.slice_and_dice(df.withColumn("dau", F.lit(1.0)), "dau", ["platform"]).collect()
    assert all(r["contribution_pct"] == 0.0 for r in flat)
    moved = growth.segment_changes(df, "dau", ["platform"]).collect()
    assert moved[0]["segment_value"] == "android" and moved[0]["dominant"]
    assert not any(r["dominant"] for r in growth.segment_changes(df.withColumn("dau", F.lit(1.0)), "dau", ["platform"]).collect())
