"""Tall-skinny QR against exact rational least squares on nearly dependent tables."""

from fractions import Fraction

import numpy as np
import pandas as pd

from gaugeline.operators import leastsq, regression


def exact(x, y):
    """Coefficients by Gauss-Jordan in rational numbers, intercept first."""
    rows = [[Fraction(1), *map(Fraction, r)] for r in x]
    p = len(rows[0])
    m = [[sum(r[i] * r[j] for r in rows) for j in range(p)] + [sum(r[i] * Fraction(v) for r, v in zip(rows, y))] for i in range(p)]
    for k in range(p):
        m[k] = [v / m[k][k] for v in m[k]]
        for i in range(p):
            if i != k:
                m[i] = [a - m[i][k] * b for a, b in zip(m[i], m[k])]
    return [float(r[p]) for r in m]


def trending(n=200):
    """Columns that nearly follow one trend, with large means: the kind of table on which cross products fail."""
    rng = np.random.default_rng(12)
    t = np.arange(n, dtype=float)
    a = 1_000_000 + 1000 * t
    b = 3 * a + np.round(rng.normal(0, 0.5, n), 2)
    c = a - b / 4 + np.round(rng.normal(0, 0.25, n), 3)
    return np.column_stack([a, b, c]), np.round(5 + 2 * a - 0.5 * b + 3 * c + rng.normal(0, 0.1, n), 4)


def test_coefficients_to_nine_digits_where_covariances_fail(spark):
    x, y = trending()
    want = np.array(exact(x.tolist(), y.tolist())[1:])
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "y"])).repartition(6)
    n, r = leastsq.triangular_factor(df)
    beta = leastsq.fit(r).beta
    cov = np.cov(np.column_stack([x, y]).T)
    direct = np.linalg.inv(cov[:3, :3]) @ cov[:3, 3]
    assert n == 200 and np.abs(beta / want - 1).max() < 1e-9 < 1e-6 < np.abs(direct / want - 1).max()
    rows = {r["feature"]: r for r in regression.regress(df, "y").collect()}
    assert all(abs(rows[f]["coefficient"] / w - 1) < 1e-9 for f, w in zip("abc", want)) and all(r["vif"] > 1e5 for r in rows.values())


def test_combinations_are_dropped_and_fit_is_the_same(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    frame = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "s": x[:, 0] + x[:, 1], "c": x[:, 2]})
    frame["y"] = 2 * frame.a - frame.b + 0.5 * frame.c + rng.normal(0, 0.1, 300)
    out = regression.regress(spark.createDataFrame(frame), "y").toPandas().set_index("feature")
    want = np.linalg.lstsq(np.column_stack([np.ones(300), frame[["a", "b", "c"]]]), frame.y, rcond=None)[0][1:]
    assert out.collinear_dropped.iloc[0] == "s" and np.allclose(out.loc[["a", "b", "c"], "coefficient"], want, rtol=1e-10)


def test_fewer_rows_than_columns_and_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 3.0, 5.0)], "a double, b double, y double")
    n, r = leastsq.triangular_factor(df)
    assert n == 2 and leastsq.fit(r).kept == [0]
    assert leastsq.triangular_factor(df.limit(0))[0] == 0
