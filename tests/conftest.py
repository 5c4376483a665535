import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def users():
    """Two thousand users in two weeks; the treatment loses activity for new android users, more so in week 2."""
    rng = np.random.default_rng(7)
    n = 2000
    base = pd.DataFrame({
        "user_id": np.arange(n), "variant": rng.choice(["control", "treatment"], n), "platform": rng.choice(["android", "ios", "web"], n),
        "user_segment": rng.choice(["new", "returning"], n), "pre_sessions": rng.normal(5, 1.5, n)})
    weeks = []
    for week, drop in ((1, 0.20), (2, 0.30)):
        w = base.copy()
        w["week"] = week
        hit = (w.platform == "android") & (w.user_segment == "new") & (w.variant == "treatment")
        w["rate"] = 0.5 + 0.06 * (w.pre_sessions - 5) + rng.normal(0, 0.1, n) - np.where(hit, drop, 0.0)
        w["notif_optout"] = (rng.random(n) < np.where(w.variant == "treatment", 0.12, 0.02)).astype(float)
        w["session_count"] = rng.poisson(3, n).astype(float)
        weeks.append(w)
    return pd.concat(weeks, ignore_index=True)


@pytest.fixture(scope="session")
def extract(spark, users):
    return spark.createDataFrame(users).cache()
