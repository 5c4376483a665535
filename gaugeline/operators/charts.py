"""Series behind charts: small projections of summaries and test results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.functions.numbers import ratio

# Column names that carry no meaning as a category or as a distribution.
UNINFORMATIVE_CATEGORIES = ("variable", "value", "metric", "measure", "column_name",
                            "statistic", "feature", "name", "key", "field")
UNINFORMATIVE_NUMBERS = ("correlation", "r", "r2", "p_value", "pvalue", "p", "coef",
                         "coefficient", "weight", "score", "rank", "index", "value")


def correlation_bars(pairs: DataFrame, top: int = 8) -> DataFrame:
    return pairs.orderBy(F.abs("correlation").desc(), "col_a", "col_b").limit(top).select(
        F.concat_ws(" x ", "col_a", "col_b").alias("pair"), F.col("correlation").alias("r"))


def missing_bars(summary: DataFrame, top: int = 10) -> DataFrame:
    """Columns with nulls by their number, as a share of all rows."""
    return summary.where("null_count > 0").orderBy(F.col("null_count").desc(), "position").limit(top).select(
        F.col("name").alias("column"), (ratio(F.col("null_count").cast("double"), F.col("non_null") + F.col("null_count")) * 100).alias("missing_pct"))


def category_bars(counts: DataFrame, column_order: list[str], top: int = 10) -> DataFrame:
    """Counts of the first text column with 2..30 values that repeat. ``counts`` are rows per (name, value)."""
    position = F.create_map(*[F.lit(x) for i, c in enumerate(column_order) for x in (c, i)])
    per_column = counts.groupBy("name").agg(F.count(F.lit(1)).alias("n_unique"), F.max("count").alias("most"))
    usable = per_column.where((F.col("n_unique") > 1) & (F.col("n_unique") <= 30) & (F.col("most") > 1)
                              & ~F.lower("name").isin(*UNINFORMATIVE_CATEGORIES))
    first = usable.agg(F.min_by("name", position[F.col("name")]).alias("name")).scalar()
    return counts.where(F.col("name") == first).orderBy(F.col("count").desc(), "value").limit(top) \
        .select("name", F.col("value").alias("category"), "count")


def spread_series(summary: DataFrame) -> DataFrame:
    """Five numbers of the column with the largest coefficient of variation, and whether its range dwarfs its middle half."""
    usable = summary.where(F.col("median").isNotNull() & F.col("std").isNotNull() & ~F.lower("name").isin(*UNINFORMATIVE_NUMBERS))
    cv = F.col("std") / F.greatest(F.abs("mean"), F.lit(1e-9))
    best = usable.orderBy(cv.desc(), "position").limit(1)
    skewed = (F.col("max") > F.col("min")) & (F.col("p75") > F.col("p25")) & ((F.col("max") - F.col("min")) > 5 * (F.col("p75") - F.col("p25")))
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("percentile"), F.col(c).alias("value")) for i, (n, c) in enumerate(
        (("Min", "min"), ("25th", "p25"), ("Median", "median"), ("75th", "p75"), ("Max", "max")))])
    return best.select("name", skewed.alias("wide_spread"), F.explode(points).alias("p")).select("name", "wide_spread", "p.*")


def effect_bar(test: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Adjusted effect with the interval of the test; both sides have one row per metric."""
    return test.join(adjusted, "metric").select("metric", F.col("cuped_ate").alias("ate"), "ci_lower", "ci_upper", "significant")


def segment_bars(effects: DataFrame, top: int = 8) -> DataFrame:
    return effects.orderBy(F.abs("effect_size").desc(), "segment").limit(top).select("segment", F.col("effect_size").alias("effect"), "significant")


def week_bars(effects: DataFrame) -> DataFrame:
    """One bar per metric and week, however many weeks there are."""
    return effects.select("metric", F.concat(F.lit("Week "), "week").alias("week"), F.col("ate").alias("effect"))


def funnel_bars(funnel: DataFrame) -> DataFrame:
    return funnel.select("step_index", "step", (F.col("control_rate") * 100).alias("control_pct"), (F.col("treatment_rate") * 100).alias("treatment_pct"))
