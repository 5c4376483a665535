"""Mergeable moments: the one pass over the extract that every A/B statistic is computed from.

The extract is reduced once to its finest cells (all keys together). Coarser
grains are sums over cells, so they never touch the extract again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.functions.names import week_number_or_error
from gaugeline.functions.numbers import as_double, ratio

RAW = ("n", "s1", "s2", "s3")
JOINT = ("j_n", "j_sy", "j_syy", "j_sx", "j_sxx", "j_sxy")


def cell_moments(df: DataFrame, keys: list[str], metrics: list[str],
                 metric: str | None = None, covariate: str | None = None) -> DataFrame:
    """One row per combination of ``keys``: row count, raw sums per metric, joint sums of metric and covariate.

    Nulls drop out per metric; the joint sums use rows where both are present.
    """
    values = [as_double(m).alias(f"{m}__y") for m in metrics]
    if covariate is not None:
        both = as_double(metric).isNotNull() & as_double(covariate).isNotNull()
        values += [F.when(both, as_double(metric)).alias("j__y"), F.when(both, as_double(covariate)).alias("j__x")]
    rows = df.select(*keys, *values)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for m in metrics:
        y = F.col(f"`{m}__y`")
        aggs += [F.count(y).alias(f"{m}__n"), F.sum(y).alias(f"{m}__s1"),
                 F.sum(y * y).alias(f"{m}__s2"), F.sum(y * y * y).alias(f"{m}__s3"),
                 F.count_if(y > 1.0).alias(f"{m}__gt1")]
    if covariate is not None:
        y, x = F.col("j__y"), F.col("j__x")
        aggs += [F.count(y).alias("j_n"), F.sum(y).alias("j_sy"), F.sum(y * y).alias("j_syy"),
                 F.sum(x).alias("j_sx"), F.sum(x * x).alias("j_sxx"), F.sum(x * y).alias("j_sxy")]
    return rows.groupBy(*keys).agg(*aggs)


def merge_cells(moments: DataFrame, by: list[str], columns: tuple[str, ...] = RAW) -> DataFrame:
    """Moments of a coarser grain: sums of the finer cells."""
    return moments.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])


def long_moments(cells: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Long form ``(metric, *by, n, s1, s2, s3, gt1)``, merged to the grain ``by``.

    The unpivot runs on cells, so its row blow-up is per cell and not per extract row.
    """
    columns = (*RAW, "gt1")
    per_metric = F.array(*[
        F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}__{c}").alias(c) for c in columns]) for m in metrics
    ])
    long = cells.select(*by, F.explode(per_metric).alias("m")).select(*by, "m.*")
    merged = merge_cells(long, ["metric", *by], columns)
    return merged.select("metric", *by, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])


def segment_moments(cells: DataFrame, segment_cols: list[str], metrics: list[str],
                    variant: str = "variant") -> DataFrame:
    """Moments per joint segment and arm, labelled ``col=value,col=value``; rows with a null segment drop out."""
    long = long_moments(cells.dropna(subset=segment_cols), [*segment_cols, variant], metrics)
    label = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in segment_cols])
    return long.select("metric", label.alias("segment"), F.col(variant).alias("variant"), *RAW)


def week_moments(cells: DataFrame, metrics: list[str], week: str = "week", variant: str = "variant") -> DataFrame:
    """Moments per normalised week and arm; labels of the same week merge, null weeks drop out, unreadable labels raise."""
    if week not in cells.columns:
        raise ValueError(f"no week column '{week}' in the extract")
    numbered = cells.where(F.col(week).isNotNull()).withColumn("_week", week_number_or_error(F.col(week)))
    long = long_moments(numbered, ["_week", variant], metrics)
    return long.select("metric", F.col("_week").alias("week"), F.col(variant).alias("variant"), *RAW)


def joint_moments(cells: DataFrame, variant: str = "variant") -> DataFrame:
    return merge_cells(cells, [variant], JOINT)


def shape_facts(df: DataFrame, entity: str, week: str | None, variant: str = "variant") -> DataFrame:
    """One row: total rows, distinct entities, distinct weeks, distinct arms."""
    weeks = F.count_distinct(week) if week else F.lit(0).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct(entity).alias("n_entities"),
                  weeks.alias("n_weeks"), F.count_distinct(variant).alias("n_variants"))


def all_grains(cells: DataFrame, metrics: list[str], segment_cols: list[str], week: str | None = "week",
               variant: str = "variant") -> DataFrame:
    """Every grain in one table: ``(grain, key, metric, variant, n, s1, s2, s3)``."""
    columns = ["grain", "key", "metric", "variant", *RAW]
    overall = long_moments(cells, [variant], metrics).select(
        F.lit("overall").alias("grain"), F.lit("").alias("key"), "metric", F.col(variant).alias("variant"), *RAW)
    out = overall
    if segment_cols:
        out = out.unionByName(segment_moments(cells, segment_cols, metrics, variant)
                              .select(F.lit("segment").alias("grain"), F.col("segment").alias("key"), *columns[2:]))
    if week and week in cells.columns:
        out = out.unionByName(week_moments(cells, metrics, week, variant)
                              .select(F.lit("week").alias("grain"), F.col("week").cast("string").alias("key"),
                                      *columns[2:]))
    return out


def arm_preview(cells: DataFrame, metric: str, variant: str = "variant") -> DataFrame:
    """Per arm: mean metric, mean covariate, number of users with a metric."""
    sums = cells.groupBy(variant).agg(
        F.sum(f"{metric}__n").alias("n_users"), F.sum(f"{metric}__s1").alias("_s1"),
        F.sum("j_n").alias("_jn"), F.sum("j_sx").alias("_sx"))
    return sums.select(F.col(variant).alias("variant"), ratio(F.col("_s1"), F.col("n_users")).alias("mean_metric"),
                       ratio(F.col("_sx"), F.col("_jn"), 0.0).alias("mean_covariate"), "n_users")
