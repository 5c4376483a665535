"""Exploratory summaries of any table. Every summary is one or a few aggregates; only result rows are ordered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gaugeline.functions.names import numeric_columns, summary_dimension
from gaugeline.functions.numbers import as_double, ratio
from gaugeline.operators.gram import pair_moments
from gaugeline.operators.quantiles import DISTINCT_BOUND, histogram_descent

# Spark generates code for up to one hundred buffer fields: eleven per pair, nine per column.
PAIRS_SIDE_BY_SIDE, COLUMNS_PER_PASS = 8, 6


def highest_variance_column(df: DataFrame, columns: list[str]) -> str | None:
    """The numeric column with the largest sample variance. One aggregate row; the first wins ties."""
    row = df.agg(*[F.var_samp(as_double(c)).alias(c) for c in columns]).first()
    known = [(row[c], -i, c) for i, c in enumerate(columns) if row[c] is not None and row[c] == row[c]]
    return max(known)[2] if known else None


def _rows_of(wide: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One row per column from a one-row aggregate with ``column__field`` names."""
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"),
                        *[F.col(f"`{c}__{f}`").alias(f) for f in fields]) for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def numeric_summary(df: DataFrame, columns: list[str] | None = None, distinct_bound: int = DISTINCT_BOUND) -> DataFrame:
    """Per numeric column: counts, mean, spread, quartiles (linear interpolation), exact distinct count.

    The first passes yield the plain statistics and an estimate of the distinct values, a few columns at a time;
    a pass reads only its own columns. Columns within the bound share a quantile aggregate, the others take the
    histogram path.
    """
    columns = columns or numeric_columns(df)
    numbers = df.select(*[as_double(c).alias(c) for c in columns])
    chunks = [columns[i:i + COLUMNS_PER_PASS] for i in range(0, len(columns), COLUMNS_PER_PASS)]
    plain = {"non_null": F.count, "rows": lambda _: F.count(F.lit(1)), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    facts: dict[str, float | int | None] = {}
    for part in chunks:
        for measures in (plain, {"size": F.approx_count_distinct}):
            row = numbers.agg(*[fn(F.col(f"`{c}`")).alias(f"{c}__{n}") for c in part for n, fn in measures.items()]).first()
            facts.update(row.asDict())
    finite = lambda v: v if v is not None and abs(v) < float("inf") else None
    basic = df.sparkSession.createDataFrame(
        [(i, c, facts[f"{c}__non_null"], facts[f"{c}__rows"] - facts[f"{c}__non_null"], *[finite(facts[f"{c}__{n}"]) for n in ("mean", "std", "min", "max")])
         for i, c in enumerate(columns)],
        "position int, name string, non_null bigint, null_count bigint, mean double, std double, min double, max double")
    narrow = [c for c in columns if facts[f"{c}__size"] <= distinct_bound]
    wide_cols = [c for c in columns if facts[f"{c}__size"] > distinct_bound]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    distinct = union([_rows_of(numbers.agg(*[F.count_distinct(f"`{c}`").alias(f"{c}__n_unique") for c in part]), part, ["n_unique"]) for part in chunks])
    quarters = [0.25, 0.5, 0.75]
    parts = []
    for at in range(0, len(narrow), COLUMNS_PER_PASS):
        part = narrow[at:at + COLUMNS_PER_PASS]
        wanted = F.array(*[F.lit(q) for q in quarters])
        parts.append(_rows_of(numbers.agg(*[F.percentile(f"`{c}`", wanted).alias(f"{c}__q") for c in part]), part, ["q"]).select("name", "q"))
    if wide_cols:
        long = numbers.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("_v")) for c in wide_cols])).alias("r"))
        parts.append(histogram_descent(long.select("r.name", "r._v").where(F.col("_v").isNotNull()), quarters, ["name"])
                     .select("name", F.col("quantiles").alias("q")))
    quartiles = union(parts)
    types = F.create_map(*[F.lit(x) for f in df.schema.fields if f.name in columns for x in (f.name, f.dataType.simpleString())])
    return basic.join(quartiles, "name", "left").join(distinct.drop("position"), "name").select(
        "name", types[F.col("name")].alias("dtype"), "non_null", "null_count", "mean", "std", "min", F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max", "n_unique", "position")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (column, value), nulls left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("r")).select("r.*").where("value IS NOT NULL").groupBy("name", "value").agg(
        F.count(F.lit(1)).alias("count"))


def categorical_summary(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """Per non-numeric column: counts, distinct values, and the most frequent values as ``value: count``."""
    columns = columns or [c for c in df.columns if c not in numeric_columns(df)]
    counts = value_counts(df, columns)
    order = W.partitionBy("name").orderBy(F.col("count").desc(), "value")
    best = counts.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top)
    listed = best.groupBy("name").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_rn", F.concat_ws(": ", "value", F.col("count").cast("string")).alias("t")))),
        lambda s: s["t"]), " | ").alias("top_values"))
    totals = counts.groupBy("name").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("count").alias("non_null"))
    nulls = _rows_of(df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}__null_count") for c in columns]), columns, ["null_count"])
    return nulls.join(totals, "name", "left").join(listed, "name", "left").select(
        "name", F.coalesce("non_null", F.lit(0)).alias("non_null"), "null_count", F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        "top_values", "position")


def trend_rows(df: DataFrame) -> DataFrame | None:
    """Means of the numeric columns by the detected time or group column; None when there is none or under four rows."""
    dim = summary_dimension(df.columns)
    numbers = [c for c in numeric_columns(df) if c != dim]
    if dim is None or not numbers or df.limit(4).count() < 4:
        return None
    return df.where(F.col(dim).isNotNull()).groupBy(dim).agg(*[F.avg(c).alias(c) for c in numbers]).orderBy(dim)


def top_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` rows with the largest value of the most variable numeric column."""
    by = highest_variance_column(df, numeric_columns(df))
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(c) for c in df.columns if c != by]).limit(n)


def correlations(df: DataFrame, top_n: int = 10, columns: list[str] | None = None, min_overlap: int = 10) -> DataFrame:
    """Strongest Pearson correlations, pairwise complete.

    Pairs are aggregated side by side, as many as one generated aggregate takes. Very many pairs come from masked Gram
    matrices of all columns, in one scan; tasks pass on matrices, never rows of pairs.
    """
    columns = columns or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    numbers = df.select(*[as_double(c).alias(c) for c in columns])

    def measures(x: Column, y: Column) -> tuple[Column, Column, Column]:
        return F.regr_r2(y, x), F.covar_samp(x, y), F.count(x + y)

    if len(pairs) <= 4 * PAIRS_SIDE_BY_SIDE:
        parts = []
        for at in range(0, len(pairs), PAIRS_SIDE_BY_SIDE):
            aggs, rows = [], []
            for i, (a, b) in enumerate(pairs[at:at + PAIRS_SIDE_BY_SIDE]):
                aggs += [m.alias(f"{n}{i}") for n, m in zip(("r2_", "cov", "n"), measures(F.col(f"`{a}`"), F.col(f"`{b}`")))]
                rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r2_{i}").alias("r2"), F.col(f"cov{i}").alias("cov"),
                                     F.col(f"n{i}").alias("overlap")))
            parts.append(numbers.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
        out = reduce(DataFrame.unionByName, parts)
    else:
        moments = pair_moments(df, columns)
        names = F.array(*[F.lit(c) for c in columns])
        r2 = F.when((F.col("var_i") > 0) & (F.col("var_j") > 0), F.least(F.pow("cov", 2) / (F.col("var_i") * F.col("var_j")), F.lit(1.0)))
        out = moments.where((F.col("var_i") < float("inf")) & (F.col("var_j") < float("inf"))).select(
            F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"), r2.alias("r2"), "cov", "overlap")
    # A constant column has no correlation: its r2 is null, or 1 with a covariance of 0.
    r = F.when((F.col("cov") != 0) | (F.col("r2") < 1), F.signum("cov") * F.sqrt("r2"))
    kept = out.withColumn("correlation", r).where((F.col("overlap") >= min_overlap) & F.col("correlation").isNotNull())
    return kept.select("col_a", "col_b", "correlation", "overlap").orderBy(F.abs("correlation").desc(), "col_a", "col_b").limit(top_n)


def breakdown(df: DataFrame, dims: list[str], metrics: list[str], order_by: str | None = None, worst_first: bool = False) -> DataFrame:
    """Means per group with the number of records; flags average to rates."""
    out = df.groupBy(*dims).agg(*[F.avg(F.col(m).cast("double")).alias(f"avg_{m}") for m in metrics], F.count(F.lit(1)).alias("total_records"))
    return out.orderBy(F.col(order_by).asc() if worst_first else F.col(order_by).desc(), *dims) if order_by else out


def trend(df: DataFrame, time: str, metrics: list[str], unit: str | None = None, agg: str = "avg") -> DataFrame:
    """Metric over time in ascending order, optionally truncated to a calendar unit."""
    at = F.date_trunc(unit, F.col(time)) if unit else F.col(time)
    fn = F.avg if agg == "avg" else F.sum
    return df.groupBy(at.alias(time)).agg(*[fn(F.col(m).cast("double")).alias(f"{agg}_{m}") for m in metrics]).orderBy(time)


def entity_profile(df: DataFrame, entity: str, metrics: list[str], order_by: str, limit: int = 20) -> DataFrame:
    """The entities with the highest mean."""
    out = df.groupBy(entity).agg(*[F.avg(F.col(m).cast("double")).alias(f"avg_{m}") for m in metrics])
    return out.orderBy(F.col(f"avg_{order_by}").desc(), entity).limit(limit)


def flag_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Numeric columns that hold only 0 and 1 (one aggregate row)."""
    row = df.agg(*[F.count_if(~F.col(c).isin(0, 1)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] == 0]


def collapse_panel(df: DataFrame, entity: str, flags: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per entity: MAX of 0/1 flags, AVG of other numbers, grouped by the kept categories."""
    numbers = [c for c in numeric_columns(df) if c != entity]
    flags = flag_columns(df, numbers) if flags is None else flags
    keys = [entity, *(keep or [])]
    return df.groupBy(*keys).agg(*[
        F.max(c).cast("double").alias(c) if c in flags else F.avg(F.col(c).cast("double")).alias(c) for c in numbers if c not in keys])


def bucketed(value: Column, upper_bounds: list[float], labels: list[str]) -> Column:
    """Label of the first bound the value does not exceed; the last label beyond."""
    if len(labels) != len(upper_bounds) + 1:
        raise ValueError("one label more than bounds is needed")
    out = F.when(value <= upper_bounds[0], labels[0])
    for bound, label in zip(upper_bounds[1:], labels[1:-1]):
        out = out.when(value <= bound, label)
    return out.otherwise(F.lit(labels[-1]))


AGE_BOUNDS, AGE_LABELS = [25, 35, 50, 65], ["18-25", "26-35", "36-50", "51-65", "66+"]


def group_metrics(df: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """Sum, mean and count of each metric per single dimension and value, all dimensions in one pass."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    long = df.select(F.explode(pairs).alias("_p"), *metrics).select("_p.*", *metrics)
    return long.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("records"), *[F.sum(F.col(m).cast("double")).alias(f"sum_{m}") for m in metrics],
        *[F.avg(F.col(m).cast("double")).alias(f"avg_{m}") for m in metrics])


def extreme_answers(groups: DataFrame, questions: list[tuple[str, str, str, bool, bool]]) -> DataFrame:
    """Answers to "which value of a dimension has the highest or lowest measure".

    Each question is ``(name, dimension, measure, highest, positive_only)`` over :func:`group_metrics` rows.
    All answers come from one aggregate; equal measures are settled by the smaller value.
    """
    aggs = []
    for name, dimension, measure, highest, positive_only in questions:
        here = (F.col("dimension") == dimension) & F.col("value").isNotNull()
        here = here & (F.col(measure) > 0) if positive_only else here
        key = -F.col(measure) if highest else F.col(measure)
        aggs.append(F.min_by("value", F.when(here, F.struct(key.alias("k"), F.col("value").alias("v")))).alias(name))
    rows = F.array(*[F.struct(F.lit(q[0]).alias("question"), F.col(q[0]).alias("answer")) for q in questions])
    return groups.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def best_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """The group with the highest mean."""
    means = df.groupBy(group).agg(F.avg(F.col(value).cast("double")).alias("mean"))
    return means.agg(F.min_by(group, F.struct((-F.col("mean")).alias("k"), F.col(group).alias("v"))).alias("best"), F.max("mean").alias("mean"))


def shares_and_ranks(df: DataFrame, group: str, value: str) -> DataFrame:
    """Total per group, share of the grand total, gap and ratio to the leader, rank."""
    totals = df.groupBy(group).agg(F.sum(F.col(value).cast("double")).alias("total"))
    everything = W.partitionBy(F.lit(1))
    lead = F.max("total").over(everything)
    return totals.select(
        group, "total", (ratio(F.col("total"), F.sum("total").over(everything)) * 100).alias("share_pct"),
        (lead - F.col("total")).alias("gap_to_leader"), ratio(lead, F.col("total")).alias("leader_ratio"),
        F.row_number().over(everything.orderBy(F.col("total").desc(), group)).cast("bigint").alias("rank"))


def ranked_list(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups in descending order of their total, as one comma-separated row."""
    totals = df.groupBy(group).agg(F.sum(F.col(value).cast("double")).alias("total"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("k"), F.col(group).cast("string").alias("g"))))
    return totals.agg(F.array_join(F.transform(listed, lambda s: s["g"]), ", ").alias("ranked"))


def lookup_sized(df: DataFrame, max_rows: int = 50) -> bool:
    """True when a lookup answer is non-empty and small enough to show as it is."""
    return 0 < df.limit(max_rows + 1).count() <= max_rows


def unique_columns(df: DataFrame) -> DataFrame:
    """Keep the first of columns that share a name."""
    first = list(dict.fromkeys(df.columns))
    if len(first) == len(df.columns):
        return df
    positional = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return positional.select(*[F.col(f"_{df.columns.index(c)}").alias(c) for c in first])


def is_flag_type(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.BooleanType)
