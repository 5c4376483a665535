"""A/B statistics from moments against row-level numpy, and the planted effects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import abtest, moments, winsor
from gaugeline.plans import experiment as plan
from gaugeline.spec import ExperimentSpec

SEGMENTS = ["platform", "user_segment"]


def cells_of(df, metric="rate"):
    return moments.cell_moments(df, ["variant", "week", *SEGMENTS], [metric, "notif_optout", "session_count"], metric, "pre_sessions")


def welch(a, b):
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    return (a.mean() - b.mean()) / np.sqrt(va + vb), (va + vb) ** 2 / (va ** 2 / (len(a) - 1) + vb ** 2 / (len(b) - 1))


def test_welch_matches_rows(extract, users):
    row = abtest.welch_test(moments.long_moments(cells_of(extract), ["variant"], ["rate"]), ["metric"]).first()
    t, c = users[users.variant == "treatment"].rate.to_numpy(), users[users.variant == "control"].rate.to_numpy()
    stat, dof = welch(t, c)
    assert row["t_stat"] == pytest.approx(stat, rel=1e-9) and row["dof"] == pytest.approx(dof, rel=1e-9)
    assert row["significant"] and row["ci_lower"] < row["mean_diff"] < row["ci_upper"] < 0
    assert row["control_mean"] == pytest.approx(c.mean()) and row["n_treatment"] == len(t)


def test_one_sided_directions(extract):
    long = moments.long_moments(cells_of(extract), ["variant"], ["rate"])
    less = abtest.welch_test(long, ["metric"], alternative="less").first()["p_value"]
    greater = abtest.welch_test(long, ["metric"], alternative="greater").first()["p_value"]
    both = abtest.welch_test(long, ["metric"]).first()["p_value"]
    assert less + greater == pytest.approx(1.0) and both == pytest.approx(2 * less)
    with pytest.raises(ValueError):
        abtest.welch_test(long, ["metric"], alternative="sideways")


def test_undefined_tests_have_a_status(spark):
    def status(rows):
        df = spark.createDataFrame(rows, "variant string, y double")
        return abtest.welch_test(moments.long_moments(moments.cell_moments(df, ["variant"], ["y"]), ["variant"], ["y"]), ["metric"]).first()
    assert status([("control", 1.0), ("control", 2.0)])["status"] == "missing arm"
    assert status([("control", 1.0), ("treatment", 2.0), ("treatment", 3.0)])["status"] == "too few observations"
    flat = status([("control", 1.0), ("control", 1.0), ("treatment", 2.0), ("treatment", 2.0)])
    assert flat["status"] == "zero variance" and flat["p_value"] is None


def test_arms_are_required(spark):
    with pytest.raises(ValueError, match="blue"):
        abtest.require_arms(spark.createDataFrame([("control",), ("blue",)], "variant string"))
    abtest.require_arms(spark.createDataFrame([("control",), ("treatment",)], "variant string"))


def test_cuped_pools_every_arm(spark, users):
    df = users.copy()
    df.loc[df.user_id % 5 == 0, "variant"] = "holdout"
    cells = moments.cell_moments(spark.createDataFrame(df), ["variant"], ["rate"], "rate", "pre_sessions")
    row = abtest.cuped(moments.joint_moments(cells)).first()
    theta = np.cov(df.rate, df.pre_sessions)[0, 1] / df.pre_sessions.var(ddof=1)
    adj = df.rate - theta * (df.pre_sessions - df.pre_sessions.mean())
    assert row["theta"] == pytest.approx(theta, rel=1e-8)
    assert row["cuped_ate"] == pytest.approx(adj[df.variant == "treatment"].mean() - adj[df.variant == "control"].mean(), rel=1e-7)
    assert row["variance_reduction_pct"] == pytest.approx((1 - adj.var() / df.rate.var()) * 100, rel=1e-7) and row["variance_reduction_pct"] > 15


def test_constant_covariate_is_reported(extract):
    flat = extract.withColumn("pre_sessions", F.lit(0.1))
    row = abtest.cuped(moments.joint_moments(cells_of(flat))).first()
    assert row["status"] == "constant covariate" and row["theta"] is None


def test_planted_segment_is_on_top(extract, users):
    segs = moments.segment_moments(cells_of(extract), SEGMENTS, ["rate"])
    effects = abtest.heterogeneous_effects(segs)
    top = abtest.top_segments(effects).first()
    assert top["segment"] == "platform=android,user_segment=new" and top["significant"] and top["effect_size"] == pytest.approx(-0.25, abs=0.03)
    assert effects.first()["segment"] == top["segment"]
    shares = [r["segment_share"] for r in effects.collect()]
    assert sum(shares) == pytest.approx(1.0)


def test_segment_share_rules_differ_with_a_third_arm(extract):
    third = extract.withColumn("variant", F.when(F.col("user_id") % 3 == 0, "holdout").otherwise(F.col("variant")))
    segs = moments.segment_moments(cells_of(third), SEGMENTS, ["rate"])
    arms = sum(r["segment_share"] for r in abtest.heterogeneous_effects(segs).collect())
    everyone = sum(r["segment_share"] for r in abtest.heterogeneous_effects(segs, share_over="all").collect())
    assert arms < 0.7 and everyone == pytest.approx(1.0)


def test_small_segments_are_left_out(extract):
    segs = moments.segment_moments(cells_of(extract.where("user_id < 100")), SEGMENTS, ["rate"])
    assert abtest.heterogeneous_effects(segs, min_segment_size=1000).count() == 0


@pytest.mark.parametrize("segment", SEGMENTS)
def test_interaction_matches_least_squares(extract, users, segment):
    row = abtest.interaction_test(abtest.interaction_cells(cells_of(extract), [segment], ["rate"])).first()
    levels = sorted(users[segment].unique())
    t = (users.variant == "treatment").to_numpy(float)
    d = np.column_stack([(users[segment] == v).to_numpy(float) for v in levels[1:]])
    one = np.ones(len(users))
    small = np.column_stack([one, t, d])
    full = np.column_stack([small, d * t[:, None]])
    rss = lambda x: ((users.rate - x @ np.linalg.lstsq(x, users.rate, rcond=None)[0]) ** 2).sum()
    f = ((rss(small) - rss(full)) / (len(levels) - 1)) / (rss(full) / (len(users) - full.shape[1]))
    assert row["f_stat"] == pytest.approx(f, rel=1e-7) and row["p_value"] < 0.001


def test_novelty_of_the_planted_effect(extract):
    row = abtest.novelty(moments.week_moments(cells_of(extract), ["rate"])).first()
    assert row["effect_direction"] == "growing" and not row["novelty_likely"] and row["week1_ate"] < 0


@pytest.mark.parametrize("a1, a2, direction, likely", [
    (0.0, 0.0, "stable", False), (0.0, 1.0, "growing", False), (0.0, -1.0, "decaying", False), (1.0, 1.05, "stable", False),
    (1.0, 0.8, "decaying", False), (1.0, 0.3, "decaying", True), (1.0, -0.95, "decaying", True), (1.0, -1.5, "growing", False)])
def test_novelty_rules(spark, a1, a2, direction, likely):
    rows = [("m", w, v, 2, 2.0 * (a if v == "treatment" else 0.0), 0.0, 0.0) for w, a in ((1, a1), (2, a2)) for v in ("control", "treatment")]
    row = abtest.novelty(spark.createDataFrame(rows, "metric string, week int, variant string, n long, s1 double, s2 double, s3 double")).first()
    assert (row["effect_direction"], row["novelty_likely"]) == (direction, likely)


def test_novelty_skips_without_two_weeks(extract):
    row = abtest.novelty(moments.week_moments(cells_of(extract.where("week = 1")), ["rate"])).first()
    assert row["status"].startswith("skipped") and not row["novelty_likely"]


def test_week_bars_show_every_week(spark):
    from gaugeline.operators import charts
    rows = [("m", w, v, 2, 2.0 * (w if v == "treatment" else 0.5), 0.0, 0.0) for w in (1, 2, 3, 7) for v in ("control", "treatment")] + [("m", 8, "control", 2, 1.0, 0.0, 0.0)]
    moments_ = spark.createDataFrame(rows, "metric string, week int, variant string, n long, s1 double, s2 double, s3 double")
    bars = {r["week"]: r["effect"] for r in charts.week_bars(abtest.week_effects(moments_)).collect()}
    assert bars == {"Week 1": 0.5, "Week 2": 1.5, "Week 3": 2.5, "Week 7": 6.5, "Week 8": None}


def test_guardrails(extract):
    long = moments.long_moments(cells_of(extract), ["variant"], ["notif_optout", "session_count"])
    rows = {r["metric"]: r for r in abtest.guardrails(long, default_direction="decrease").collect()}
    assert rows["notif_optout"]["breached"] and rows["notif_optout"]["direction"] == "increase"
    assert not rows["session_count"]["breached"] and rows["session_count"]["direction"] == "decrease"
    other = abtest.guardrails(long, harm_directions={"notif_optout": "decrease"}).where("metric = 'notif_optout'").first()
    assert not other["breached"]


def test_sample_ratio(spark):
    df = spark.createDataFrame([("m", "control", 5000, 0.0, 0.0, 0.0), ("m", "treatment", 4000, 0.0, 0.0, 0.0)], "metric string, variant string, n long, s1 double, s2 double, s3 double")
    row = abtest.sample_ratio(df, ["metric"]).first()
    assert row["srm_detected"] and row["chi2"] == pytest.approx(111.1111, abs=1e-3)
    assert not abtest.sample_ratio(df, ["metric"], expected_ratio=5 / 9).first()["srm_detected"]


def test_winsorised_values_match_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = [(("control", "treatment")[i % 2], float(v)) for i, v in enumerate(rng.lognormal(3, 1.5, 1000))]
    out = winsor.winsorise(spark.createDataFrame(pdf, "variant string, revenue double"), "revenue", 0.01).toPandas()
    for arm in ("control", "treatment"):
        raw = np.array([v for a, v in pdf if a == arm])
        lo, hi = np.percentile(raw, 1), np.percentile(raw, 99)
        assert np.sort(out[out.variant == arm].revenue) == pytest.approx(np.sort(np.clip(raw, lo, hi)))


def test_mde_and_power_rows(extract):
    tests = abtest.welch_test(moments.long_moments(cells_of(extract), ["variant"], ["rate", "session_count"]), ["metric"])
    rows = {r["metric"]: r for r in abtest.detectable_effect(tests).collect()}
    assert rows["rate"]["is_powered"] and rows["rate"]["post_hoc_power"] > 0.8
    assert 0.04 < rows["session_count"]["post_hoc_power"] < 1


def test_mde_of_a_zero_mean_is_infinite(spark):
    df = spark.createDataFrame([(10, 10, 0.0, 1.0, 0.5)], "n_control long, n_treatment long, control_mean double, control_var double, mean_diff double")
    assert abtest.detectable_effect(df).first()["mde_relative_pct"] == float("inf")


def test_boolean_and_wide_integer_metrics(spark):
    df = spark.createDataFrame([("control", True, 3_000_000_000), ("control", False, 4_000_000_000), ("treatment", True, 5_000_000_000), ("treatment", True, 7_000_000_000)],
                               "variant string, flag boolean, big long")
    rows = {(r["metric"], r["variant"]): r for r in moments.long_moments(moments.cell_moments(df, ["variant"], ["flag", "big"]), ["variant"], ["flag", "big"]).collect()}
    assert rows["flag", "control"]["s1"] == 1.0 and rows["big", "treatment"]["s3"] == pytest.approx(5e9 ** 3 + 7e9 ** 3)


def test_extract_weeks_and_double_assignment(spark):
    events = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-10", 3.0), ("a", "2024-01-17", 5.0), ("a", "2024-01-30", 9.0), ("b", "2024-01-11", 2.0)],
                                   "user_id string, date string, v double").withColumn("date", F.to_date("date"))
    exp = spark.createDataFrame([(u, v, "2024-01-10", w) for u, v in (("a", "control"), ("b", "treatment")) for w in (1, 2)], "user_id string, variant string, assignment_date string, week int")
    spec = ExperimentSpec("v", "pre", metric_source_col="v", covariate_source_col="v")
    dated = {(r["user_id"], r["week"]): r for r in plan.experiment_extract(events, exp, spec).collect()}
    assert dated["a", 1]["v"] == 3.0 and dated["a", 2]["v"] == 5.0 and dated["a", 1]["pre"] == 1.0 and dated["b", 1]["pre"] == 0.0 and dated["a", 3]["v"] == 9.0 and len(dated) == 4
    assert plan.experiment_extract(events, exp, spec, last_week=2).count() == 3
    assigned = {(r["user_id"], r["week"]): r for r in plan.experiment_extract(events, exp, spec, "assignment").collect()}
    assert len(assigned) == 4 and assigned["a", 1]["v"] == assigned["a", 2]["v"] == pytest.approx(17 / 3)


def test_spec_validation():
    with pytest.raises(ValueError):
        ExperimentSpec("", "x")
    with pytest.raises(ValueError):
        ExperimentSpec("m", "x", metric_direction="up")
    with pytest.raises(ValueError):
        ExperimentSpec("m", "x", segment_cols=(" ",))
    spec = ExperimentSpec.from_dict({"primary_metric": "m", "covariate": "x", "guardrail_metrics": ["m", "g"], "segment_cols": [], "unknown": 1})
    assert spec.extra_guardrails == ("g",) and spec.metric_source_col == "m" and spec.alternative == "greater"


@pytest.mark.parametrize("missing", ["control", "treatment"])
def test_cells_need_both_arms(spark, extract, missing):
    from gaugeline.plans.experiment import experiment_cells
    from gaugeline.spec import ExperimentSpec
    spec = ExperimentSpec(primary_metric="rate", metric_source_col="rate", covariate="pre_sessions", covariate_source_col="session_count",
                          guardrail_metrics=("notif_optout",), segment_cols=("platform", "user_segment"), experiment_start="2024-01-15")
    assert experiment_cells(extract, spec).count() > 0
    with pytest.raises(ValueError, match="must contain both"):
        experiment_cells(extract.where(F.col("variant") != missing), spec)
