"""Bending-trend forecasts: coefficients against a direct solve, optimality, coverage on planted bends, and the general flow."""

import numpy as np
import pandas as pd
import pytest

from gaugeline.operators import forecast
from gaugeline.operators.forecast import Prior


def planted(rng, n=120, ahead=14, noise=0.02):
    """A series whose trend bends at random places, with a weekly season."""
    slope = np.cumsum(np.where(rng.random(n + ahead) < 0.03, rng.laplace(0, 0.01, n + ahead), 0.0)) + 0.004
    days = np.arange(n + ahead) + 19_700
    return days, 5 + np.cumsum(slope) + 0.3 * np.sin(2 * np.pi * days / 7) + rng.normal(0, noise, n + ahead)


def test_laplace_solution_is_optimal():
    rng = np.random.default_rng(0)
    days, y = planted(rng)
    prior, train = Prior(), 120
    places = forecast.bend_places(days[:train], prior)
    x, v = forecast.design(days[:train].astype(float), places.astype(float), float(days[0]), float(days[train - 1] - days[0])), y[:train] / np.abs(y[:train]).max()
    beta = forecast.solve_laplace(x.T @ x, x.T @ v, float(v @ v), train, len(places), prior)
    noise = float(np.mean((v - x @ beta) ** 2))
    slope = x.T @ (v - x @ beta)
    bends, edge = beta[2:2 + len(places)], noise / prior.bends
    assert len(places) == 25 and 0 < (bends != 0).sum() < 20
    assert np.all(np.abs(slope[2:27]) <= edge * 1.01 + 1e-6) and np.allclose(slope[2:27][bends != 0], edge * np.sign(bends[bends != 0]), rtol=0.02)
    assert np.abs(slope[:2]).max() < 1e-4


def test_ridge_equals_augmented_least_squares():
    rng = np.random.default_rng(1)
    days, y = planted(rng)
    prior = Prior("ridge", 0.5, 0.25, count=4)
    out = forecast.fit_and_compare(days, y, 14, prior, 1)
    train, scale = 120, np.abs(y[:120]).max()
    places = days[[j * 113 // 4 for j in range(1, 5)]]
    t = lambda d: (d - days[0]) / (days[119] - days[0])
    x = lambda d: np.column_stack([np.ones(len(d)), t(d), *[np.maximum(t(d) - t(p), 0) for p in places],
                                   *[f(2 * np.pi * k * d / 7) for f in (np.sin, np.cos) for k in (1, 2, 3)]])
    root = np.diag(np.sqrt([1e-6] * 2 + [0.5] * 4 + [0.25] * 6))
    beta = np.linalg.lstsq(np.vstack([x(days[:train]), root]), np.concatenate([y[:train] / scale, np.zeros(12)]), rcond=None)[0]
    assert np.allclose(out["yhat"], x(days[train:]) @ beta * scale)


def test_bands_cover_planted_bends_and_beat_a_straight_line(spark):
    rng = np.random.default_rng(5)
    frames = []
    for s in range(60):
        days, y = planted(rng)
        frames.append(pd.DataFrame({"s": f"s{s}", "date": pd.to_datetime(days, unit="D").date, "value": y}))
    frames.append(pd.DataFrame({"s": "short", "date": frames[0]["date"][:3], "value": [1.0, 2.0, None]}))
    out = forecast.changepoint_forecast(spark.createDataFrame(pd.concat(frames)), ["s"]).toPandas()
    short, out = out[out.s == "short"], out[out.s != "short"]
    assert len(short) == 1 and short.warning.notna().all() and short.yhat.isna().all()
    assert len(out) == 60 * 14 and (out.groupby("s").bends.max() > 0).mean() > 0.9
    inside = ((out.actual >= out.yhat_lower) & (out.actual <= out.yhat_upper)).mean()
    assert 0.8 < inside <= 1.0
    from gaugeline.operators import timeseries
    line = timeseries.seasonal_forecast(spark.createDataFrame(pd.concat(frames[:-1])), ["s"]).toPandas()
    assert (out.actual - out.yhat).abs().mean() < 0.6 * (line.actual - line.yhat).abs().mean()
    assert ((line.actual >= line.yhat_lower) & (line.actual <= line.yhat_upper)).mean() < inside


@pytest.mark.parametrize("rows,ok", [(5, False), (6, True)])
def test_general_flow_needs_six_rows(spark, rows, ok):
    frame = pd.DataFrame({"date": [f"2024-03-{d + 1:02d}" for d in range(rows)] + ["unknown"], "amount": [float(d * d) for d in range(rows + 1)], "order_id": range(rows + 1)})
    out = forecast.general_flow(spark.createDataFrame(frame))
    assert (out is not None) == ok
    if ok:
        out = out.toPandas().sort_values("date")
        assert len(out) == 6 and out.yhat.notna().sum() == 2 and out.anomaly.notna().all()


def test_general_flow_without_time_or_metric(spark):
    assert forecast.general_flow(spark.createDataFrame([("a", 1.0)], "name string, amount double")) is None
    assert forecast.general_flow(spark.createDataFrame([("2024-01-01", "a")], "date string, name string")) is None
