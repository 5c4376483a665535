"""Masked Gram matrices against pandas and Spark's own correlation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import explore, gram


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(900, 6))
    x = base @ rng.normal(size=(6, 40)) + rng.normal(size=(900, 40)) + rng.choice([0.0, 1e6, -3e9], 40)
    frame = pd.DataFrame(x, columns=[f"v{i}" for i in range(40)])
    frame = frame.mask(rng.random(frame.shape) < 0.15)
    frame["constant"], frame["nothing"], frame["thin"] = 0.1, np.nan, np.where(np.arange(900) < 5, np.arange(900), np.nan)
    return frame


@pytest.mark.parametrize("widest", [1024, 12])
def test_pairwise_complete_moments(spark, wide, widest):
    columns = list(wide.columns)
    df = spark.createDataFrame(wide).repartition(7)
    got = gram.pair_moments(df, columns, widest).toPandas()
    assert len(got) == len(columns) * (len(columns) - 1) // 2 == len(got[["i", "j"]].drop_duplicates()) and (got.i < got.j).all()
    for r in got.itertuples():
        both = wide[[columns[r.i], columns[r.j]]].dropna()
        assert r.overlap == len(both)
        if len(both) > 1:
            want = both.cov().to_numpy()
            assert np.allclose([r.cov, r.var_i, r.var_j], [want[0, 1], want[0, 0], want[1, 1]], rtol=1e-7, atol=1e-9)


def test_wide_correlations_agree_with_spark(spark, wide):
    df = spark.createDataFrame(wide).repartition(3)
    out = explore.correlations(df, 10_000).collect()
    names = {x for r in out for x in (r["col_a"], r["col_b"])}
    assert not {"constant", "nothing", "thin"} & names and len(out) == 40 * 39 // 2
    for r in out[::97]:
        a, b = (F.when(~F.isnan(c), F.col(c)) for c in (r["col_a"], r["col_b"]))
        # Spark's running means lose digits on columns of 3e9
        assert abs(df.select(F.corr(a, b)).first()[0] - r["correlation"]) < 1e-7
        both = wide[[r["col_a"], r["col_b"]]].dropna()
        assert abs((both - both.iloc[0]).corr().iloc[0, 1] - r["correlation"]) < 1e-11


def test_infinities_and_empty_tables(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(rng.normal(size=(60, 10)), columns=list("abcdefghij"))
    frame.loc[3, "a"] = np.inf
    df = spark.createDataFrame(frame)
    out = explore.correlations(df, 1000).collect()
    assert len(out) == 36 and not any("a" in (r["col_a"], r["col_b"]) for r in out)
    assert explore.correlations(df.limit(0), 1000).count() == 0


def test_five_hundred_columns_in_one_scan(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(400, 500)), columns=[f"x{i}" for i in range(500)])
    frame["x499"] = -frame["x0"] + rng.normal(0, 0.01, 400)
    df = spark.createDataFrame(frame)
    out = explore.correlations(df, 3).collect()
    assert (out[0]["col_a"], out[0]["col_b"]) == ("x0", "x499") and abs(out[0]["correlation"] - frame["x0"].corr(frame["x499"])) < 1e-12
    plan = gram.pair_moments(df, list(frame.columns))._jdf.queryExecution().toString()
    assert plan.count("Scan") <= 4 and "Generate" not in plan
