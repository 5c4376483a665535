"""Textbook values of the distribution functions."""

import itertools
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from gaugeline.functions import prob, tails


@pytest.mark.parametrize("q, dof, t", [(0.975, 1, 12.7062047), (0.975, 10, 2.2281389), (0.95, 5, 2.0150484), (0.995, 30, 2.7499957), (0.975, 1e8, 1.9599640)])
def test_t_quantiles(q, dof, t):
    assert prob.t_ppf(q, dof) == pytest.approx(t, abs=1e-6)
    assert prob.t_sf(t, dof) == pytest.approx(1 - q, abs=1e-8)
    assert prob.t_ppf(1 - q, dof) == pytest.approx(-t, abs=1e-6)


def test_t_for_large_dof_meets_its_expansion():
    for t in (0.3, 1.9, 4.0):
        assert prob.t_sf(t, 0.999e6) == pytest.approx(prob.t_sf(t, 1.001e6), rel=1e-4)


@pytest.mark.parametrize("x, dof, p", [(3.841458821, 1, 0.05), (6.634896601, 1, 0.01), (18.307038053, 10, 0.05), (0.0, 1, 1.0)])
def test_chi_square(x, dof, p):
    assert prob.chi2_sf(x, dof) == pytest.approx(p, abs=1e-9)


@pytest.mark.parametrize("x, d1, d2, p", [(4.9646027, 1, 10, 0.05), (3.3258345, 5, 10, 0.05), (2.0, 2, 2000, 0.1356), (0.0, 3, 3, 1.0)])
def test_f(x, d1, d2, p):
    assert prob.f_sf(x, d1, d2) == pytest.approx(p, abs=1e-4)


def test_normal():
    assert prob.norm_sf(1.959963985) == pytest.approx(0.025, abs=1e-10)
    assert prob.norm_ppf(0.8) == pytest.approx(0.8416212, abs=1e-7)


def test_non_central_t_against_simulation():
    rng = np.random.default_rng(3)
    for dof, nc, t in ((10, 1.0, 2.2), (198, 2.5, 1.97), (5, 0.0, 1.0)):
        draws = (rng.normal(nc, 1, 400_000)) / np.sqrt(rng.chisquare(dof, 400_000) / dof)
        assert prob.nct_cdf(t, dof, nc) == pytest.approx((draws <= t).mean(), abs=4e-3)
    assert prob.nct_cdf(1.3, 12, 0.0) == pytest.approx(1 - prob.t_sf(1.3, 12), abs=1e-9)


def test_power_of_a_textbook_design():
    # Two arms of 64, effect size one half: about 80 percent.
    ncp = 0.5 / math.sqrt(2 / 64)
    assert prob.post_hoc(ncp, 126, 0.05) == pytest.approx(0.8015, abs=2e-3)


def test_columns_keep_nulls(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0)], "t double, dof double")
    rows = [r[0] for r in df.select(tails.t_two_sided("t", "dof")).collect()]
    assert rows[0] == pytest.approx(0.3632175, abs=1e-6) and rows[1] is None


@pytest.mark.parametrize("dof", [1e3, 1e6, 1e9])
def test_t_tail_is_one_formula_at_all_sizes(dof):
    """Against Simpson's rule over the density in extended precision."""
    for t in (0.5, 1.96, 5.0):
        x = np.linspace(np.longdouble(t), np.longdouble(t + 60), 400_001)
        log_c = prob._log_gamma_step(dof / 2, 0.5) - 0.5 * np.log(np.pi * np.longdouble(dof))
        y = np.exp(log_c - (np.longdouble(dof) + 1) / 2 * np.log1p(x * x / np.longdouble(dof)))
        w = np.ones(len(x), dtype=np.longdouble)
        w[1:-1:2], w[2:-1:2] = 4, 2
        assert math.isclose(prob.t_sf(t, dof), float((w * y).sum() * (x[1] - x[0]) / 3), rel_tol=1e-7)


# ---- the same as columns ----

DOFS = [1, 1.7, 2, 3, 5, 10, 30, 99.5, 200, 1e3, 1e4, 1e6]
COLUMNS = {
    "norm_sf": (tails.norm_sf, prob.norm_sf, [np.linspace(-9, 30, 100)], 1e-12),
    "t_sf": (tails.t_sf, prob.t_sf, [[-8, -2, -0.1, 0, 1e-4, 0.3, 1, 1.5, 1.9, 2.5, 4, 9, 30], DOFS], 1e-12),
    "f_sf": (tails.f_sf, prob.f_sf, [[1e-3, 0.2, 0.9, 1.1, 3, 20], [1, 2, 5, 17], [3, 40, 1000, 1e5]], 1e-12),
    "chi2_sf": (tails.chi2_sf, prob.chi2_sf, [[0, 1e-4, 0.5, 1, 3.84, 20, 200], [1, 2, 3, 10, 100, 1e4]], 1e-12),
    "t_ppf": (tails.t_ppf, prob.t_ppf, [[0.025, 0.5, 0.9, 0.975, 0.999, 1 - 1e-9], DOFS], 1e-11),
    "post_hoc_power": (tails.post_hoc_power, prob.post_hoc, [[0, 0.5, 2.8, 6], [1, 2, 5, 30, 1e3, 1e6], [0.05, 0.01]], 1e-10),
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_agree_with_numbers_and_start_no_worker(spark, name):
    column, number, grids, tolerance = COLUMNS[name]
    grid = [tuple(float(v) for v in row) for row in itertools.product(*grids)]
    df = spark.createDataFrame(grid + [(None,) * len(grids), (float("nan"),) * len(grids)], [f"a{i}" for i in range(len(grids))])
    shown = df.withColumn("p", column(*[F.col(c) for c in df.columns]))
    assert "EvalPython" not in shown._jdf.queryExecution().toString()
    out = [r["p"] for r in shown.collect()]
    assert out[-2:] == [None, None]
    for row, got in zip(grid, out):
        assert got == pytest.approx(number(*row), rel=tolerance, abs=1e-290), row


def test_test_queries_start_no_worker(spark):
    from registry.catalog import ENTRIES
    for name in ("welch_test_directed", "segment_effects", "sample_ratio", "guardrails", "post_hoc_power", "conditional_funnel"):
        plan = ENTRIES[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "ArrowEvalPython" not in plan, name
