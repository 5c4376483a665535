"""Exact quantiles (linear interpolation) that stay bounded per task.

``percentile`` keeps one counter per distinct value in one aggregation buffer.
That is right while the number of distinct values is bounded, so it is checked
first. Beyond the bound the quantile is found by histogram descent: count
logarithmic bins, descend into the bins that hold the wanted ranks, count finer
bins there, and finish on the distinct values of the last bins. Every step is a
partially aggregated count; nothing is dropped or approximated. Nulls and
NaN are left out; infinities are ranked as the outermost values on both ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeline.session import cut_lineage

DISTINCT_BOUND = 200_000
BROADCAST_BINS = 100_000
_FINE_BINS = 4096
_COARSE_PER_DOUBLING = 64


def quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None,
              distinct_bound: int = DISTINCT_BOUND, distinct_hint: int | None = None) -> DataFrame:
    """One row per ``keys``: ``n`` and the array column ``quantiles`` in the order of ``probs``.

    ``distinct_hint`` (an already known upper estimate) saves the size check.
    """
    keys = keys or []
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if distinct_hint is None:
        per_key = base.groupBy(*keys).agg(F.approx_count_distinct("_v").alias("d")) if keys \
            else base.agg(F.approx_count_distinct("_v").alias("d"))
        distinct_hint = per_key.agg(F.max("d")).first()[0] or 0
    if distinct_hint <= distinct_bound:
        wanted = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]))
        aggs = [F.count("_v").alias("n"), wanted.alias("quantiles")]
        return base.groupBy(*keys).agg(*aggs) if keys else base.agg(*aggs)
    return histogram_descent(base, probs, keys)


def _coarse_bin(v: Column) -> Column:
    """Order-preserving logarithmic bin: independent of the data, about 64 per doubling."""
    size = F.when(F.abs(v) == float("inf"), 1_000_000).otherwise(F.floor(F.log2(F.abs(v)) * _COARSE_PER_DOUBLING).cast("int") + 100_000)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0)


def _keep_wanted(bins: DataFrame, wanted: DataFrame, group: list[str], bin_col: str) -> DataFrame:
    """Bins that hold a wanted rank, with the rank counted from the start of the bin.

    ``bins`` has a bounded number of rows per group (its histogram), so the running sum is bounded too.
    """
    order = W.partitionBy(*group).orderBy(bin_col)
    placed = bins.withColumn("_upto", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    inside = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))
    return placed.join(wanted, group).where(inside).withColumn("_rank", F.col("_rank") - (F.col("_upto") - F.col("_n"))).drop("_upto")


def _into(bins: DataFrame) -> DataFrame:
    """Join hint for the bins to descend into: broadcast while their number is small, which is counted first."""
    return F.broadcast(bins) if bins.limit(BROADCAST_BINS + 1).count() <= BROADCAST_BINS else bins


def _asked_ranks(totals: DataFrame, probs: list[float], keys: list[str]) -> DataFrame:
    """The two neighbouring ranks of every probability and the weight of the upper one."""
    asked = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p")) for i, p in enumerate(probs)])
    at = totals.withColumn("_t", F.explode(asked)).select(*keys, "_total", "_t._i", ((F.col("_total") - 1) * F.col("_t._p")).alias("_h"))
    return at.select(*keys, "_total", "_i", (F.col("_h") - F.floor("_h")).alias("_part"), F.floor("_h").alias("_low"),
                     F.least(F.floor("_h") + 1, F.col("_total") - 1).alias("_high"))


def histogram_descent(base: DataFrame, probs: list[float], keys: list[str]) -> DataFrame:
    """The large-data path of :func:`quantiles` over ``(*keys, _v)`` rows without nulls.

    Three passes over the data. What a pass leaves behind is a few bins per key; it is written out before the
    next pass, so no pass is repeated.
    """
    anonymous = not keys
    if anonymous:
        base, keys = base.withColumn("_all", F.lit(0)), ["_all"]
    counts = lambda df, by: df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    coarse = cut_lineage(counts(base.withColumn("_b1", _coarse_bin(F.col("_v"))), [*keys, "_b1"]))
    targets = _asked_ranks(coarse.groupBy(*keys).agg(F.sum("_n").alias("_total")), probs, keys)
    ranks = targets.select(*keys, F.explode(F.array("_low", "_high")).alias("_rank")).distinct().withColumn("_want", F.col("_rank"))

    level1 = cut_lineage(_keep_wanted(coarse, ranks, keys, "_b1").select(*keys, "_b1", "_rank", "_want", "_lo", "_hi"))
    settled = level1.where("_lo = _hi").select(*keys, "_want", F.col("_lo").alias("_value"))
    open1 = level1.where("_lo < _hi")
    spans = open1.select(*keys, "_b1", "_lo", "_hi").distinct()
    inside1 = base.withColumn("_b1", _coarse_bin(F.col("_v"))).join(_into(spans), [*keys, "_b1"])
    position = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _FINE_BINS
    placed = inside1.withColumn("_b2", F.least(F.floor(position), F.lit(_FINE_BINS - 1)).cast("int"))
    bins2 = counts(placed.drop("_lo", "_hi"), [*keys, "_b1", "_b2"])
    level2 = cut_lineage(_keep_wanted(bins2, open1.drop("_lo", "_hi"), [*keys, "_b1"], "_b2")
                         .select(*keys, "_b1", "_b2", "_rank", "_want", "_lo", "_hi"))

    settled = settled.unionByName(level2.where("_lo = _hi").select(*keys, "_want", F.col("_lo").alias("_value")))
    open2 = level2.where("_lo < _hi").select(*keys, "_b1", "_b2", "_rank", "_want")
    inside2 = placed.join(_into(open2.select(*keys, "_b1", "_b2").distinct()), [*keys, "_b1", "_b2"], "left_semi")
    values = inside2.groupBy(*keys, "_b1", "_b2", "_v").agg(F.count(F.lit(1)).alias("_n"))
    exact = _keep_wanted(values, open2, [*keys, "_b1", "_b2"], "_v").select(*keys, "_want", F.col("_v").alias("_value"))
    found = settled.unionByName(exact)

    ends = targets.withColumn("_want", F.explode(F.array_distinct(F.array("_low", "_high"))))
    points = ends.join(found, [*keys, "_want"]).groupBy(*keys, "_i", "_part", "_total").agg(
        F.min("_value").alias("_a"), F.max("_value").alias("_b"))
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")
    points = points.withColumn("_q", F.when((F.col("_part") == 0) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise(between))
    out = points.groupBy(*keys).agg(F.max("_total").alias("n"), F.transform(
        F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("quantiles"))
    return out.drop("_all") if anonymous else out
