"""Winsorised metrics: clip each arm to its own quantiles before the moments are taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.operators.quantiles import quantiles


def clip_bounds(df: DataFrame, metric: str, pct: float, variant: str = "variant") -> DataFrame:
    """Lower and upper clip value per arm: the interpolated ``pct`` and ``1-pct`` quantiles."""
    q = quantiles(df, metric, [pct, 1.0 - pct], [variant])
    return q.select(variant, F.col("quantiles")[0].alias("clip_low"), F.col("quantiles")[1].alias("clip_high"))


def winsorise(df: DataFrame, metric: str, pct: float, variant: str = "variant") -> DataFrame:
    """Replace the metric by its clipped value. The bounds have one row per arm, so Spark joins them by broadcast."""
    bounds = clip_bounds(df, metric, pct, variant)
    clipped = F.least(F.greatest(F.col(metric).cast("double"), F.col("clip_low")), F.col("clip_high"))
    return df.join(bounds, variant, "left") \
        .withColumn(metric, F.when(F.col(metric).isNotNull(), clipped)).drop("clip_low", "clip_high")
