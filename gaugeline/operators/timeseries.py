"""Anomalies and forecasts over daily series; many series run in parallel, one partition key per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeline.functions.names import series_metric_candidates, series_time_column
from gaugeline.functions.numbers import ratio


def daily_series(df: DataFrame, value: str, date: str = "date", series: list[str] | None = None, agg: str = "sum") -> DataFrame:
    """One row per series and day: the sum (or mean) of the value. Rows without a usable date drop out."""
    day = (F.col(date) if dict(df.dtypes)[date] != "string" else F.try_to_timestamp(date)).cast("date")
    y = F.col(value).cast("double")
    return df.withColumn("date", day).where(F.col("date").isNotNull()).groupBy(*(series or []), "date").agg(
        (F.sum(y) if agg == "sum" else F.avg(y)).alias("value"))


def general_series(df: DataFrame) -> DataFrame | None:
    """The series of a general table: first time column, highest-variance metric, mean per date. None when absent."""
    from gaugeline.operators.explore import highest_variance_column
    time = series_time_column(df.columns)
    metrics = series_metric_candidates(df)
    if time is None or not metrics:
        return None
    metric = highest_variance_column(df, metrics)
    if metric is None:
        return None
    rows = df.select(F.col(time).alias("date"), F.col(metric).alias("value")).dropna()
    return daily_series(rows, "value", agg="mean")


def _whole(series: list[str]):
    return W.partitionBy(*series) if series else W.partitionBy(F.lit(1))


def rolling_anomalies(daily: DataFrame, series: list[str] | None = None, window: int = 14, threshold: float = 2.5) -> DataFrame:
    """Trailing z-score per date and a flag. When nothing exceeds the threshold it is relaxed once by 0.5.

    A flat stretch keeps the last spread that was not zero, then the spread of the whole series, then 1.
    """
    series = series or []
    whole = _whole(series)
    ordered = whole.orderBy("date")
    trailing = ordered.rowsBetween(-(window - 1), 0)
    needed = max(3, window // 2)
    enough = F.count("value").over(trailing) >= needed
    spread = F.when(enough, F.nullif(F.stddev_samp("value").over(trailing), F.lit(0.0)))
    out = daily.withColumns({
        "_n": F.count(F.lit(1)).over(whole),
        "rolling_mean": F.when(enough, F.avg("value").over(trailing)),
        "_spread": spread,
        "_overall": F.coalesce(F.nullif(F.stddev_samp("value").over(whole), F.lit(0.0)), F.lit(1.0)),
    }).where("_n >= 3")
    out = out.withColumn("rolling_std", F.coalesce(
        F.last("_spread", ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, 0)), F.col("_overall")))
    out = out.withColumn("z", F.coalesce(ratio(F.col("value") - F.col("rolling_mean"), F.col("rolling_std")), F.lit(0.0)))
    out = out.withColumn("severity", F.max(F.abs("z")).over(whole))
    limit = F.when(F.col("severity") > threshold, F.lit(threshold)).otherwise(F.lit(threshold - 0.5))
    out = out.withColumn("anomaly", F.abs("z") > limit)
    mean_flagged = F.avg(F.when(F.col("anomaly"), F.col("z"))).over(whole)
    return out.withColumn("direction", F.when(mean_flagged < 0, "drop").otherwise("spike")) \
        .select(*series, "date", "value", "rolling_mean", "rolling_std", "z", "anomaly", "severity", "direction")


def anomaly_summary(anomalies: DataFrame, series: list[str] | None = None) -> DataFrame:
    """One row per series: flagged dates in order, severity, direction."""
    dates = F.array_sort(F.collect_list(F.when(F.col("anomaly"), F.col("date").cast("date").cast("string"))))
    aggs = [F.array_join(dates, ",").alias("anomaly_dates"), F.max("severity").alias("severity"), F.first("direction").alias("direction")]
    return anomalies.groupBy(*series).agg(*aggs) if series else anomalies.agg(*aggs)


def _with_holdout(daily: DataFrame, series: list[str], holdout: int) -> DataFrame:
    """Number the dates and mark the last ``holdout`` as test (a third of a short series)."""
    whole = _whole(series)
    out = daily.withColumns({"_t": F.row_number().over(whole.orderBy("date")), "_n": F.count(F.lit(1)).over(whole)})
    days = F.when(F.col("_n") > holdout, F.lit(holdout)).otherwise(F.greatest(F.lit(1), F.floor(F.col("_n") / 3)))
    out = out.withColumn("_train_n", (F.col("_n") - days).cast("int"))
    return out.withColumn("_train", F.col("_t") <= F.col("_train_n"))


def _compared(df: DataFrame, series: list[str], yhat: Column, half_width: Column, method: str) -> DataFrame:
    """Test dates with forecast, band and actual; series with under three training dates report a warning."""
    whole = _whole(series)
    short = F.col("_train_n") < 3
    test = df.where(~F.col("_train")).select(
        *series, "date", F.col("value").alias("actual"), F.when(~short, yhat).alias("yhat"),
        F.when(~short, yhat - half_width).alias("yhat_lower"), F.when(~short, yhat + half_width).alias("yhat_upper"),
        F.when(short, "series too short for a reliable forecast").alias("warning"))
    outside = (F.col("actual") < F.col("yhat_lower")) | (F.col("actual") > F.col("yhat_upper"))
    delta = F.avg("actual").over(whole) - F.avg("yhat").over(whole)
    return test.withColumns({
        "actual_vs_forecast_delta": F.coalesce(delta, F.lit(0.0)),
        "outside_ci": F.coalesce(F.bool_or(outside).over(whole), F.lit(False)), "method": F.lit(method)})


def rolling_forecast(daily: DataFrame, series: list[str] | None = None, holdout: int = 14) -> DataFrame:
    """Mean of the last seven training values, two standard deviations of all training values around it."""
    series = series or []
    whole = _whole(series)
    marked = _with_holdout(daily, series, holdout)
    recent = F.col("_train") & (F.col("_t") > F.col("_train_n") - 7)
    fitted = marked.withColumns({
        "_yhat": F.avg(F.when(recent, F.col("value"))).over(whole),
        "_half": 2.0 * F.coalesce(F.stddev_samp(F.when(F.col("_train"), F.col("value"))).over(whole), F.lit(0.0))})
    return _compared(fitted, series, F.col("_yhat"), F.col("_half"), "rolling_mean")


def seasonal_forecast(daily: DataFrame, series: list[str] | None = None, holdout: int = 14) -> DataFrame:
    """Linear trend plus day-of-week means of its residuals, 95 % band from what is left."""
    series = series or []
    whole = _whole(series)
    train = lambda c: F.when(F.col("_train"), c)
    out = _with_holdout(daily, series, holdout).withColumn("_d", F.unix_date(F.col("date").cast("date")).cast("double"))
    y, x = train(F.col("value")), train(F.col("_d"))
    out = out.withColumns({"_slope": ratio(F.covar_samp(y, x).over(whole), F.var_samp(x).over(whole), 0.0),
                           "_my": F.avg(y).over(whole), "_mx": F.avg(x).over(whole)})
    out = out.withColumn("_trend", F.col("_my") + F.col("_slope") * (F.col("_d") - F.col("_mx")))
    out = out.withColumns({"_dow": F.dayofweek("date"), "_res": train(F.col("value") - F.col("_trend"))})
    by_day = W.partitionBy(*series, "_dow")
    out = out.withColumn("_season", F.coalesce(F.avg("_res").over(by_day), F.lit(0.0)))
    left = F.stddev_samp(F.col("_res") - F.col("_season")).over(whole)
    out = out.withColumns({"_yhat": F.col("_trend") + F.col("_season"), "_half": 1.96 * F.coalesce(left, F.lit(0.0))})
    return _compared(out, series, F.col("_yhat"), F.col("_half"), "weekly_seasonal")


def forward_fill(df: DataFrame, value: str, order: str, series: list[str] | None = None) -> DataFrame:
    """Replace nulls by the last known value of the series."""
    frame = _whole(series or []).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(frame))


def first_and_last(df: DataFrame, value: str, order: str, series: list[str] | None = None) -> DataFrame:
    """First and last value by time and whether it grew; partial aggregation, no sort."""
    aggs = [F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value")]
    g = df.groupBy(*series).agg(*aggs) if series else df.agg(*aggs)
    return g.withColumn("trend", F.when(F.col("last_value") > F.col("first_value"), "growth").otherwise("decline"))
