"""Growth accounting on bitmaps against windows over users."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import activity, growth


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(8)
    users = rng.integers(0, 300, 4000)
    days = rng.integers(0, 60, 4000)
    keep = (days < 20) | (days > 33)  # dates without any row
    frame = pd.DataFrame({"user_id": users, "date": [datetime.date(2024, 1, 1) + datetime.timedelta(int(d)) for d in days], "value": rng.normal(size=4000)})[keep]
    frame["platform"] = frame.user_id.map(lambda u: ["ios", "web", None][u % 3])
    frame["name"] = frame.user_id.map(lambda u: f"user {u * 7919}")
    frame["far"] = frame.user_id.astype("int64") * 10**14
    frame["installed"] = [datetime.date(2023, 12, 20) + datetime.timedelta(int(u) % 40) for u in frame.user_id]
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("user", ["user_id", "name", "far"])
@pytest.mark.parametrize("window,new", [(28, 7), (3, 1), (1, 30)])
def test_equal_to_windows(log, user, window, new):
    known = log.where("platform IS NOT NULL")
    options = {"dims": ["platform"], "user": user, "window_days": window, "new_days": new, "rates": ["value"]}
    assert rows(activity.growth_accounting(known, **options).drop("avg_value")) == rows(growth.growth_accounting(known, **options).drop("avg_value"))


def test_equal_with_installs_and_a_condition(log):
    options = {"dims": [], "install_date": "installed", "window_days": 5, "active": F.col("value") > 0}
    got, want = (f.growth_accounting(log, **options) for f in (activity, growth))
    assert rows(got) == rows(want) and got.count() > 20


def test_sliding_unions():
    rng = np.random.default_rng(1)
    days = rng.integers(0, 2**63, (23, 3)).astype(np.uint64) & rng.integers(0, 2**63, (23, 3)).astype(np.uint64)
    for width in (1, 2, 5, 23, 40):
        got = activity.sliding_unions(days, width)
        for d in range(23):
            assert (got[d] == np.bitwise_or.reduce(days[max(0, d - width):d], axis=0, initial=0)).all()


def test_reach_of_any_dates(log):
    maps = activity.day_bitmaps(log, "user_id", "date")
    for low, high in (("2024-01-03", "2024-01-05"), ("2024-01-10", "2024-02-20"), ("2025-01-01", "2025-01-02")):
        want = log.where(F.col("date").between(low, high)).select("user_id").distinct().count()
        assert activity.reach(maps, low, high).first()[0] == want


def test_empty(spark):
    none = spark.createDataFrame([], "user_id long, date date, platform string")
    assert activity.growth_accounting(none, ["platform"]).count() == 0
