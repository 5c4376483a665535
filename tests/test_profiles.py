"""Profiles of parts add up to the profile of the whole."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.sources import catalog, profiles


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"day": rng.integers(1, 5, 20_000), "x": np.round(rng.lognormal(2, 1, 20_000), 3), "k": rng.integers(0, 3000, 20_000)})
    frame["name"] = frame.k.map(lambda k: None if k % 10 == 0 else f"n{k}")
    frame["nothing"] = pd.Series([None] * 20_000, dtype="Float64")
    return spark.createDataFrame(frame).repartition(6)


def test_parts_add_up_within_the_stated_errors(spark, table, tmp_path):
    folder, day = f"{tmp_path}/state", F.format_string("d%02d", F.col("day"))
    for d in (1, 2, 3, 4, 3):  # one day comes twice
        profiles.store(profiles.profile_state(table.where(F.col("day") == d), day), folder)
    stored = profiles.stored(spark, folder)
    assert stored.count() == 4 * 5
    parts, whole = (profiles.shown(s).toPandas().set_index("column") for s in (profiles.merged(stored), profiles.merged(profiles.profile_state(table, F.lit("all")))))
    frame = table.toPandas()
    for c in ("x", "k", "name", "nothing"):
        a, b = parts.loc[c], whole.loc[c]
        assert (a["n"], a.non_null, a["first"], a["last"]) == (b["n"], b.non_null, b["first"], b["last"]) and a.non_null == frame[c].notna().sum()
        assert a.about_distinct == b.about_distinct and (c == "nothing" or abs(a.about_distinct / frame[c].nunique() - 1) < 0.05)
    for c in ("x", "k"):
        assert np.isclose(parts.loc[c, "mean"], frame[c].mean()) and np.isclose(parts.loc[c, "std"], frame[c].std())
        for q, name in ((0.25, "about_p25"), (0.5, "about_median"), (0.75, "about_p75")):
            assert abs((frame[c] <= parts.loc[c, name]).mean() - q) < 0.03
    assert pd.isna(parts.loc["nothing", "about_median"]) and pd.isna(parts.loc["name", "mean"])


def test_months_of_days_and_overlap(table):
    state = profiles.profile_state(table, F.col("day"))
    halves = profiles.shown(profiles.merged(state, F.when(F.col("part") <= "2", "early").otherwise("late"))).where("column = 'x'").toPandas().set_index("part")
    frame = table.toPandas()
    assert halves.loc["early", "n"] == (frame.day <= 2).sum() and halves.loc["late", "n"] == (frame.day > 2).sum()
    row = profiles.overlap(state, "k", "1", "2").first()
    one, two = (set(frame[frame.day == d].k) for d in (1, 2))
    assert abs(row["about_both"] / len(one & two) - 1) < 0.08 and abs(row["about_first_only"] / len(one - two) - 1) < 0.2 and abs(row["about_second_only"] / len(two - one) - 1) < 0.2


def test_snapshots_are_appended_and_read(spark, table, tmp_path):
    folder = f"{tmp_path}/snapshots"
    old, new = catalog.columns_of({"t": table.select("day", "x")}), catalog.columns_of({"t": table.select("day", F.col("x").cast("string"))})
    for rows, at in ((old, "2024-01-01 00:00:00"), (new, "2024-01-02 00:00:00"), (new, "2024-01-02 00:00:00")):
        catalog.append_snapshot(rows, "c1", at, folder)
    catalog.append_snapshot(old, "c2", "2023-01-01 00:00:00", folder)
    assert catalog.read_snapshots(spark, folder).count() == 6
    latest = catalog.latest_snapshot(catalog.read_snapshots(spark, folder))
    assert [tuple(r) for r in catalog.schema_changes(latest.where("connection_id = 'c2'"), latest.where("connection_id = 'c1'")).select("column", "change").collect()] == [("x", "retyped")]
