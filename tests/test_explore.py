import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gaugeline.operators import explore, quality, quantiles, regression


@pytest.mark.parametrize("draw", ["lognormal", "few", "signed", "constant", "outlier"])
def test_histogram_descent_equals_numpy(spark, draw):
    rng = np.random.default_rng(11)
    values = {"lognormal": rng.lognormal(0, 6, 5000), "few": rng.integers(0, 3, 5000).astype(float), "signed": rng.normal(0, 1e-3, 5000),
              "constant": np.full(50, 3.25), "outlier": np.append(rng.random(3000), [1e300, -1e300, 0.0])}[draw]
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(values)) % 2, "v": values}))
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    for r in quantiles.quantiles(df, "v", probs, ["k"], distinct_bound=0, distinct_hint=1).collect():
        mine = values[np.arange(len(values)) % 2 == r["k"]]
        assert r["quantiles"] == pytest.approx(list(np.quantile(mine, probs)), rel=1e-12) and r["n"] == len(mine)
    whole = quantiles.quantiles(df, "v", probs, distinct_bound=0, distinct_hint=1).first()["quantiles"]
    assert whole == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40))
def test_both_quantile_paths_agree(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    a = quantiles.quantiles(df, "v", [0.1, 0.5], distinct_hint=1).first()["quantiles"]
    b = quantiles.quantiles(df, "v", [0.1, 0.5], distinct_bound=0, distinct_hint=1).first()["quantiles"]
    assert a == pytest.approx(b, rel=1e-9, abs=1e-12)


def test_summary_handles_nulls_and_text(spark):
    df = spark.createDataFrame([(1.0, "a", True), (None, "b", True), (3.0, "b", None)], "x double, s string, f boolean")
    row = explore.numeric_summary(df).first()
    assert (row["non_null"], row["null_count"], row["median"], row["n_unique"]) == (2, 1, 2.0, 2)
    cats = {r["name"]: r for r in explore.categorical_summary(df).collect()}
    assert cats["s"]["top_values"] == "b: 2 | a: 1" and cats["f"]["null_count"] == 1 and cats["f"]["n_unique"] == 1


def test_correlations_skip_constants_and_short_overlaps(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    pdf = pd.DataFrame({"a": x, "b": 2 * x + 0.01 * rng.normal(size=200), "c": 1.0, "d": [1.0] * 5 + [None] * 195})
    out = explore.correlations(spark.createDataFrame(pdf)).collect()
    assert [(r["col_a"], r["col_b"]) for r in out] == [("a", "b")] and out[0]["correlation"] > 0.99


def test_many_correlation_pairs_agree_with_pandas(spark):
    pdf = pd.DataFrame(np.random.default_rng(1).normal(size=(60, 10)), columns=list("abcdefghij"))
    pdf["j"] = pdf.a * 0.5 + pdf.j
    got = {(r["col_a"], r["col_b"]): r["correlation"] for r in explore.correlations(spark.createDataFrame(pdf), 100).collect()}
    want = pdf.corr()
    assert len(got) == 45 and all(r == pytest.approx(want.loc[k], abs=1e-9) for k, r in got.items())


def test_wide_regression_takes_the_vector_path(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(300, 9)), columns=list("abcdefghi"))
    pdf["y"] = pdf @ np.arange(9) + rng.normal(size=300)
    got = {r["feature"]: r["coefficient"] for r in regression.regress(spark.createDataFrame(pdf), "y").collect()}
    beta = np.linalg.lstsq(np.column_stack([np.ones(300), pdf[list("abcdefghi")]]), pdf.y, rcond=None)[0]
    assert all(got[c] == pytest.approx(beta[i + 1], rel=1e-6, abs=1e-9) for i, c in enumerate("abcdefghi"))


def test_trend_rows_and_dimension_choice(spark):
    df = spark.createDataFrame([("n", "2024-01", 1.0), ("s", "2024-02", 3.0), ("n", "2024-02", 5.0), ("s", "2024-01", 2.0)], "region string, month string, v double")
    assert [tuple(r) for r in explore.trend_rows(df).collect()] == [("2024-01", 1.5), ("2024-02", 4.0)]
    assert explore.trend_rows(df.limit(3)) is None and explore.trend_rows(df.select("v")) is None


def test_unique_columns_and_lookup_size(spark):
    df = spark.range(3).select("id", (F.col("id") * 2).alias("id"))
    assert explore.unique_columns(df).columns == ["id"] and explore.unique_columns(df).collect()[2]["id"] == 2
    assert explore.lookup_sized(spark.range(50)) and not explore.lookup_sized(spark.range(51)) and not explore.lookup_sized(spark.range(0))


def test_panel_collapse_keeps_flags(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 4.0), (2, 0, 1.0)], "customer_id int, churned int, mrr double")
    rows = {r["customer_id"]: r for r in explore.collapse_panel(df, "customer_id").collect()}
    assert rows[1]["churned"] == 1.0 and rows[1]["mrr"] == 3.0


def test_regression_matches_least_squares(spark):
    rng = np.random.default_rng(8)
    n = 400
    pdf = pd.DataFrame({"age": rng.normal(40, 10, n), "dept": rng.choice(["eng", "hr", "ops"], n), "noise": rng.normal(size=n), "flat": 1.0, "name": [f"n{i}" for i in range(n)]})
    pdf["salary"] = 1000 + 30 * pdf.age + pdf.dept.map({"eng": 500, "hr": 0, "ops": -200}) + rng.normal(0, 50, n)
    pdf["copy"] = 2 * pdf.age
    pdf.loc[:9, "noise"] = np.nan
    rows = {r["feature"]: r for r in regression.regress(spark.createDataFrame(pdf), hint="what drives salary?").collect()}
    noise = pdf.noise.fillna(pdf.noise.median())
    x = np.column_stack([np.ones(n), pdf.age, noise, pdf.dept == "hr", pdf.dept == "ops"]).astype(float)
    beta = np.linalg.lstsq(x, pdf.salary, rcond=None)[0]
    res = pdf.salary - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (res @ res) / (n - 5))
    kept = "age" if "age" in rows else "copy"
    scale = 1.0 if kept == "age" else 0.5
    assert rows[kept]["coefficient"] == pytest.approx(beta[1] * scale, rel=1e-6) and rows["dept_ops"]["coefficient"] == pytest.approx(beta[4], rel=1e-6)
    assert rows["dept_hr"]["std_err"] == pytest.approx(se[3], rel=1e-6) and rows["dept_hr"]["significant"]
    assert rows["noise"]["collinear_dropped"] in ("age", "copy") and "flat" not in rows and not any(k.startswith("name") for k in rows)
    assert rows["noise"]["r_squared"] == pytest.approx(1 - (res @ res) / ((pdf.salary - pdf.salary.mean()) ** 2).sum(), rel=1e-8)


def test_regression_refuses_small_inputs(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(5)], "x double, y double")
    with pytest.raises(ValueError, match="observations"):
        regression.regress(df, "y")
    with pytest.raises(ValueError, match="target"):
        regression.regress(df.select(F.col("x").cast("string").alias("x")))


def test_inflated_features_are_flagged(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=200)
    pdf = pd.DataFrame({"a": a, "b": a + 0.05 * rng.normal(size=200), "c": rng.normal(size=200)})
    pdf["y"] = pdf.a + pdf.c + rng.normal(size=200)
    flagged = {r["feature"] for r in regression.inflated_features(regression.regress(spark.createDataFrame(pdf), "y")).collect()}
    assert flagged == {"a", "b"}


def test_content_checks_fire(spark):
    fan = spark.createDataFrame([(u % 30, ("control", "treatment")[u % 2], 50.0) for u in range(300)], "user_id int, variant string, open_rate double")
    fired = {r["check"] for r in quality.content_checks(fan, "open_rate").collect() if r["fired"]}
    assert fired == {"join_fan_out", "percentage_not_rate"}
    lopsided = spark.createDataFrame([(u, "control" if u < 90 else "treatment", 0.5) for u in range(100)], "user_id int, variant string, rate double")
    assert {r["check"] for r in quality.content_checks(lopsided, "rate").collect() if r["fired"]} == {"arm_imbalance"}
    assert {r["check"] for r in quality.content_checks(lopsided.limit(0), "rate").collect() if r["fired"]} == {"no_rows"}
    assert "missing_arm" in {r["check"] for r in quality.content_checks(lopsided.where("user_id < 50"), "rate").collect() if r["fired"]}
