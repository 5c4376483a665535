"""Growth accounting on user bitmaps: one bitmap per day and 32,768 users, set algebra in place of windows over users.

The events are read once and leave one bitmap per day and bucket of users, built on the map side. A task then holds one
bucket: all its days, 4 KB each, however many events lie behind them. Unions over a sliding window come from running ORs within
blocks of the window's length, forwards and backwards, so that each costs one OR whatever the length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.operators.growth import COMPONENTS
from gaugeline.session import cut_lineage

WORDS = 4096 // 8
#: numbers may be this much sparser than users before they are replaced by dense ones
SPARSE = 64


def numbered(rows: DataFrame, user: str) -> DataFrame:
    """``rows`` with ``_bit``, a number per user that is dense enough for bitmaps: the user's own if that is one."""
    if dict(rows.dtypes)[user] in ("tinyint", "smallint", "int", "bigint"):
        low, high, users = rows.agg(F.min(user), F.max(user), F.approx_count_distinct(user)).first()
        if low is None or (low >= 0 and high - low <= SPARSE * max(users, 1024)):
            return rows.withColumn("_bit", F.col(user).cast("bigint"))
    # numbers count up within a task, so they fill bitmaps whatever the task; the written table fixes them
    names = cut_lineage(rows.select(F.col(user).alias("_name")).distinct().withColumn("_bit", F.monotonically_increasing_id()))
    return rows.join(names, F.col(user) == F.col("_name")).drop("_name")


def sliding_unions(days: np.ndarray, width: int) -> np.ndarray:
    """Row d: the OR of rows d - width … d - 1 of ``days`` (days × words)."""
    n = len(days)
    padded = np.zeros((width + -(-(n + width) // width) * width, days.shape[1]), dtype=days.dtype)
    padded[width:width + n] = days  # row d of days is row d + width here, and its window starts at row d
    blocks = padded.reshape(-1, width, days.shape[1])
    ahead = np.bitwise_or.accumulate(blocks, axis=1).reshape(padded.shape)
    back = np.bitwise_or.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(padded.shape)
    at = np.arange(n)
    return back[at] | ahead[at + width - 1]


def _counts(sets: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sets).sum(axis=1, dtype=np.int64)


def bucket_accounting(frame: pd.DataFrame, window: int, new_days: int, installs: bool) -> pd.DataFrame:
    """Counts per day of one bucket of users from its bitmaps per day (columns day, seen, fresh, old)."""
    start = int(frame["day"].min())
    at = frame["day"].to_numpy(dtype="int64") - start
    length = int(at.max()) + 1 + window  # users still churn after the last day
    def laid_out(name):
        sets = np.zeros((length, WORDS), dtype=np.uint64)
        for i, b in zip(at, frame[name]):
            if b is not None:
                sets[i] = np.frombuffer(b, dtype=np.uint64)
        return sets
    seen = laid_out("seen")
    recent = sliding_unions(seen, window)
    before = np.zeros_like(seen)
    before[1:] = np.bitwise_or.accumulate(seen, axis=0)[:-1]
    older = np.zeros_like(seen)
    older[window:] = before[:length - window]
    if installs:
        new = laid_out("fresh") & ~laid_out("old")
    else:
        first = seen & ~before
        new = seen & (sliding_unions(first, new_days - 1) | first) if new_days > 1 else first
    gone = np.zeros_like(seen)
    gone[window:] = seen[:length - window] & ~seen[window:]
    out = pd.DataFrame({"day": np.arange(length) + start, "dau": _counts(seen), "new_users": _counts(new), "retained_users": _counts(seen & recent),
                        "resurrected_users": _counts(seen & older & ~recent), "churned_users": _counts(gone)})
    return out[out.drop(columns="day").any(axis=1)]


def growth_accounting(events: DataFrame, dims: list[str], user: str = "user_id", date: str = "date", install_date: str | None = None,
                      rates: list[str] | None = None, window_days: int = 28, new_days: int = 7, active: Column | None = None) -> DataFrame:
    """The rows of :func:`gaugeline.operators.growth.growth_accounting`, from bitmaps. Dimensions belong to the user; rows without a user or date are left out."""
    rates, counts = rates or [], ["dau", *[f"{c}_users" for c in COMPONENTS]]
    day = F.unix_date(F.col(date).cast("date"))
    rows = (events if active is None else events.where(active)).where(F.col(user).isNotNull() & F.col(date).cast("date").isNotNull())
    rows = numbered(rows, user).withColumn("_day", day)
    # one column for the place of the bit: null where a row is not in the set
    place = F.bitmap_bit_position("_bit")
    age = F.col("_day") - F.unix_date(F.col(install_date).cast("date")) if install_date else F.lit(None).cast("int")
    bitmap = lambda which: F.bitmap_construct_agg(place) if which is None else F.bitmap_construct_agg(F.when(which, place))
    maps = rows.groupBy(*dims, F.bitmap_bucket_number("_bit").alias("_bucket"), "_day").agg(
        bitmap(None).alias("seen"), *([bitmap(age < new_days).alias("fresh"), bitmap(age >= new_days).alias("old")] if install_date else []))
    maps = cut_lineage(maps.withColumnRenamed("_day", "day"))
    kinds = dict(events.dtypes)
    named = "".join(f"`{d}` {kinds[d]}, " for d in dims)

    def bucket(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = bucket_accounting(frame, window_days, new_days, install_date is not None)
        return out.assign(**dict(zip(dims, key)))[[*dims, "day", *counts]]

    each = maps.groupBy(*dims, "_bucket").applyInPandas(bucket, f"{named}day int, " + ", ".join(f"{c} bigint" for c in counts))
    sums = each.groupBy(F.date_from_unix_date("day").alias("date"), *dims).agg(*[F.sum(c).alias(c) for c in counts])
    dates = maps.agg(F.array_sort(F.collect_set(F.date_from_unix_date("day")))).scalar()
    out = maps.select(*dims).distinct().withColumn("date", F.explode(dates)).join(sums, ["date", *dims], "left")
    if rates:
        means = events.groupBy(F.col(date).cast("date").alias("date"), *dims).agg(*[F.avg(F.col(r).cast("double")).alias(f"avg_{r}") for r in rates])
        out = out.join(means, ["date", *dims], "left")
    return out.select("date", *dims, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
                      *[F.coalesce(F.col(f"avg_{r}"), F.lit(0.0)).alias(f"avg_{r}") for r in rates])


def day_bitmaps(events: DataFrame, user: str, date: str) -> DataFrame:
    """date, bucket, users (a bitmap): sets that later days add to, with ``bitmap_or_agg``, without reading old events again.

    Users must be whole numbers that are not much sparser than the users themselves.
    """
    bit = F.col(user).cast("bigint")
    return events.where(bit.isNotNull()).groupBy(F.col(date).cast("date").alias("date"), F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("users"))


def reach(bitmaps: DataFrame, low: str, high: str) -> DataFrame:
    """One row: different users between two dates, both included, from :func:`day_bitmaps`."""
    within = bitmaps.where(F.col("date").between(F.lit(low).cast("date"), F.lit(high).cast("date")))
    return within.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reach"))
