"""Daily activity: growth accounting, component and segment decompositions, slice-and-dice.

All of these first reduce the events to one row per day (or per user and day); later windows only see
those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gaugeline.functions.numbers import ratio

COMPONENTS = ("new", "retained", "resurrected", "churned")


def daily_metric(events: DataFrame, date: str, metric: str, agg: str = "mean", dims: list[str] | None = None,
                 name: str | None = None) -> DataFrame:
    """Metric per date and dimensions straight from events."""
    value = {"mean": F.avg(F.col(metric).cast("double")), "sum": F.sum(F.col(metric).cast("double")),
             "count": F.count(F.lit(1)).cast("double")}[agg]
    return events.groupBy(F.col(date).alias("date"), *(dims or [])).agg(value.alias(name or metric))


def daily_rollup(daily: DataFrame, date: str, dims: list[str], columns: list[str] | None = None) -> DataFrame:
    """Sum the component columns that are present over date and the dimensions that are present."""
    wanted = columns or ["dau", *[f"{c}_users" for c in COMPONENTS]]
    present = [c for c in wanted if c in daily.columns]
    keys = [date, *[d for d in dims if d in daily.columns]]
    return daily.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in present])


def two_level_average(events: DataFrame, date: str, value: str, by: list[str]) -> DataFrame:
    """Sum per date and group, then the mean of the daily sums per group."""
    per_day = events.groupBy(date, *by).agg(F.sum(F.col(value).cast("double")).alias("_s"))
    return per_day.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.avg("_s").alias(f"avg_daily_{value}"))


def growth_accounting(events: DataFrame, dims: list[str], user: str = "user_id", date: str = "date",
                      install_date: str | None = None, rates: list[str] | None = None, window_days: int = 28,
                      new_days: int = 7, active: Column | None = None) -> DataFrame:
    """Per date and dimensions: active, new, retained, resurrected and churned users, and mean rates.

    A user is active on a date when a row exists (or ``active`` holds on one). Dimensions belong to the
    user. Without ``install_date`` the first active day stands in. Windows per user run over distinct
    days, so the most active user holds at most one row per day.
    """
    rates = rates or []
    counted = events if active is None else events.where(active)
    first = [F.min(F.col(install_date).cast("date")).alias("_install")] if install_date else []
    days = counted.groupBy(user, F.col(date).cast("date").alias("_day"), *dims).agg(F.count(F.lit(1)).alias("_rows"), *first)
    days = days.withColumn("_num", F.unix_date("_day"))
    by_day = W.partitionBy(user).orderBy("_num")
    days = days.withColumns({
        "_gap": F.col("_num") - F.lag("_num").over(by_day),
        "_back": F.count(F.lit(1)).over(by_day.rangeBetween(window_days, window_days)),
        "_first": F.col("_install") if install_date else F.min("_day").over(W.partitionBy(user)),
    })
    dates = days.agg(F.array_sort(F.collect_set("_day"))).scalar()
    today = days.groupBy(F.col("_day").alias("date"), *dims).agg(
        F.count(F.lit(1)).alias("dau"),
        F.count_if(F.date_diff("_day", "_first") < new_days).alias("new_users"),
        F.count_if(F.col("_gap") <= window_days).alias("retained_users"),
        F.count_if(F.col("_gap") > window_days).alias("resurrected_users"))
    churn = days.where("_back = 0").groupBy(F.date_add("_day", window_days).alias("date"), *dims).agg(
        F.count(F.lit(1)).alias("churned_users"))
    grid = days.select(*dims).distinct().withColumn("date", F.explode(dates))
    out = grid.join(today, ["date", *dims], "left").join(churn, ["date", *dims], "left")
    if rates:
        means = events.groupBy(F.col(date).cast("date").alias("date"), *dims).agg(
            *[F.avg(F.col(r).cast("double")).alias(f"avg_{r}") for r in rates])
        out = out.join(means, ["date", *dims], "left")
    counts = ["dau", *[f"{c}_users" for c in COMPONENTS]]
    return out.select("date", *dims, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
                      *[F.coalesce(F.col(f"avg_{r}"), F.lit(0.0)).alias(f"avg_{r}") for r in rates])


def active_user_sets(events: DataFrame, user: str, date: str, day: str, window_days: int = 28) -> DataFrame:
    """Users of one day by activity set: ``today``, ``retained`` = today ∩ prior, ``returning`` = (today - prior) ∩ older,
    ``lost`` = active exactly ``window_days`` ago - today, ``reach`` = today ∪ prior.

    The set algebra is evaluated per user from membership flags: one pass, one shuffle.
    """
    age = F.date_diff(F.lit(day).cast("date"), F.col(date).cast("date"))
    within = lambda low, high: F.bool_or(age.between(low, high))
    flags = events.where(age >= 0).groupBy(user).agg(
        within(0, 0).alias("today"), within(1, window_days).alias("prior"),
        F.bool_or(age > window_days).alias("older"), within(window_days, window_days).alias("exactly"))
    today, prior = F.col("today"), F.col("prior")
    names = F.array_compact(F.array(
        F.when(today, "today"), F.when(today & prior, "retained"), F.when(today & ~prior & F.col("older"), "returning"),
        F.when(F.col("exactly") & ~today, "lost"), F.when(today | prior, "reach")))
    return flags.select(user, F.explode(names).alias("set"))


def component_changes(daily: DataFrame, date: str = "date", window_days: int = 28,
                      series: list[str] | None = None) -> DataFrame:
    """Baseline (first ``window_days`` dates, or half of a short series) against the rest, per component.

    The dominant component has the most negative change, or the largest change when none fell.
    """
    series = series or []
    per_date = daily.groupBy(*series, date).agg(
        F.sum("dau").alias("dau"), *[F.sum(f"{c}_users").alias(c) for c in COMPONENTS])
    whole = W.partitionBy(*series) if series else W.partitionBy(F.lit(1))
    numbered = per_date.withColumns({"_rn": F.row_number().over(whole.orderBy(date)), "_n": F.count(F.lit(1)).over(whole)})
    cut = F.when(F.col("_n") > window_days, F.lit(window_days)).otherwise(F.floor(F.col("_n") / 2))
    flagged = numbered.where("_n >= 2").withColumn("_base", F.col("_rn") <= cut)
    parts = F.array(*[F.struct(F.lit(i).alias("component_index"), F.lit(c).alias("component"), F.col(c).alias("value"))
                      for i, c in enumerate(COMPONENTS)])
    rows = flagged.select(*series, "_base", "dau", F.explode(parts).alias("p")).select(*series, "_base", "dau", "p.*")
    g = rows.groupBy(*series, "component_index", "component").agg(
        F.avg(F.when(F.col("_base"), F.col("value"))).alias("baseline_avg"),
        F.avg(F.when(~F.col("_base"), F.col("value"))).alias("recent_avg"),
        F.avg("value").alias("_mean"), F.avg("dau").alias("_dau"))
    g = g.withColumns({
        "delta": F.col("recent_avg") - F.col("baseline_avg"),
        "pct_of_dau": F.col("_mean") / F.when(F.col("_dau") > 0, F.col("_dau")).otherwise(1.0) * 100})
    fallen = F.least(F.col("delta"), F.lit(0.0))
    order = whole.orderBy(fallen.asc(), F.abs("delta").desc(), "component_index")
    return g.withColumn("dominant", F.row_number().over(order) == 1) \
        .select(*series, "component", "baseline_avg", "recent_avg", "delta", "pct_of_dau", "dominant")


def day_of(df: DataFrame, date: str) -> Column:
    """The day of a time column; dates and text dates stay as they are."""
    return F.col(date).cast("date") if isinstance(df.schema[date].dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(date)


def split_date(daily: DataFrame, date: str, given: str | None = None) -> Column:
    """The before/after cut: a given date or the middle distinct day (a one-value subquery over the days)."""
    date_type = daily.schema[date].dataType
    if given is not None:
        return F.lit(given).cast(date_type)
    dates = F.array_sort(F.collect_set(day_of(daily, date)))
    return daily.agg(F.get(dates, F.floor(F.size(dates) / 2).cast("int")).cast(date_type).alias("split")).scalar()


def _segment_cells(df: DataFrame, metric: str, segment_cols: list[str], date: str) -> DataFrame:
    """Sum and count per day and joint segments: every later number is a sum over these cells."""
    y = F.col(metric).cast("double")
    return df.groupBy(day_of(df, date).alias(date), *segment_cols).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"), F.count(F.lit(1)).alias("_rows"))


def _unpivot_segments(cells: DataFrame, segment_cols: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("segment_col"), F.col(c).cast("string").alias("segment_value"))
                      for c in segment_cols])
    return cells.withColumn("_p", F.explode(pairs)).select("*", "_p.*").where(F.col("segment_value").isNotNull())


def segment_changes(df: DataFrame, metric: str, segment_cols: list[str], date: str = "date",
                    split_at: str | None = None) -> DataFrame:
    """Mean before and after the cut per segment value; contribution is the share of absolute movement."""
    cells = _segment_cells(df, metric, segment_cols, date)
    after = F.col(date) >= split_date(df, date, split_at)
    long = _unpivot_segments(cells.withColumn("_after", after), segment_cols)
    side = lambda flag, c: F.sum(F.when(F.col("_after") == flag, F.col(c)))
    g = long.groupBy("segment_col", "segment_value").agg(
        side(False, "_s").alias("_s0"), side(False, "_n").alias("_n0"), side(True, "_s").alias("_s1"), side(True, "_n").alias("_n1"))
    g = g.withColumns({"metric_before": ratio(F.col("_s0"), F.col("_n0")), "metric_after": ratio(F.col("_s1"), F.col("_n1"))}) \
        .where("metric_before IS NOT NULL AND metric_after IS NOT NULL") \
        .withColumn("delta", F.col("metric_after") - F.col("metric_before"))
    moved = g.agg(F.struct(
        F.sum(F.abs("delta")).alias("total"), F.sum("delta").alias("net"), F.max("delta").alias("up"), F.min("delta").alias("down"),
        F.min_by(F.struct("segment_col", "segment_value"), F.struct((-F.abs("delta")).alias("a"), "segment_col", "segment_value")).alias("top"))
        .alias("m")).scalar()
    g = g.withColumn("_m", moved)
    is_top = (F.col("segment_col") == F.col("_m.top.segment_col")) & (F.col("segment_value") == F.col("_m.top.segment_value"))
    return g.select(
        "segment_col", "segment_value", "metric_before", "metric_after", "delta",
        (ratio(F.abs("delta"), F.col("_m.total"), 0.0) * 100).alias("contribution_pct"),
        (is_top & (F.col("_m.total") > 0)).alias("dominant"),
        ((F.col("_m.up") > 0) & (F.col("_m.down") < 0) & (F.abs("_m.net") < 0.5 * F.col("_m.total"))).alias("cancelling")) \
        .orderBy(F.abs("delta").desc(), "segment_col", "segment_value")


def slice_and_dice(df: DataFrame, metric: str, dims: list[str], date: str = "date", split_at: str | None = None) -> DataFrame:
    """Per-day averages before and after the cut per dimension value; contribution is the signed share of the total change."""
    cells = _segment_cells(df, metric, dims, date)
    facts = df.agg(F.collect_set(day_of(df, date)).alias("d")).select(F.struct(F.array_sort("d").alias("dates")).alias("f")).scalar()
    cells = cells.withColumns({"_dates": facts["dates"], "_split": split_date(df, date, split_at)})
    days = lambda test: F.greatest(F.size(F.filter(F.col("_dates"), test)), F.lit(1))
    cells = cells.withColumns({"_after": F.col(date) >= F.col("_split"),
                               "_d0": days(lambda d: d < F.col("_split")), "_d1": days(lambda d: d >= F.col("_split"))})
    side = lambda flag: F.coalesce(F.sum(F.when(F.col("_after") == flag, F.col("_s"))), F.lit(0.0))
    change = side(True) / F.max("_d1") - side(False) / F.max("_d0")
    long = _unpivot_segments(cells, dims)
    g = long.groupBy(F.col("segment_col").alias("dimension"), F.col("segment_value").alias("value")).agg(change.alias("delta"))
    total = cells.agg(change.alias("t")).scalar()
    g = g.withColumn("contribution_pct", F.coalesce(F.try_divide("delta", F.nullif(total, F.lit(0.0))) * 100, F.lit(0.0)))
    return g.orderBy(F.abs("contribution_pct").desc(), "dimension", "value")
