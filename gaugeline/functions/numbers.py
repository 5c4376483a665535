"""Numeric column helpers: guarded division, moment arithmetic, report rounding and formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

POSITIVE_INFINITY = float("inf")


def as_double(name: str) -> Column:
    """Metric columns are aggregated as doubles; booleans become 1.0 / 0.0, and not-a-number counts as missing."""
    return F.nullif(F.col(f"`{name}`").cast("double"), F.lit(float("nan")))


def ratio(numerator: Column, denominator: Column, otherwise: float | None = None) -> Column:
    """Division that yields ``otherwise`` (null by default) on a zero denominator."""
    quotient = F.try_divide(numerator, denominator)
    return quotient if otherwise is None else F.coalesce(quotient, F.lit(otherwise))


def mean_of(n: Column, s1: Column) -> Column:
    return ratio(s1, n)


def sample_variance_of(n: Column, s1: Column, s2: Column) -> Column:
    """Sample variance from raw sums; rounding noise below zero is clamped."""
    spread = s2 - s1 * ratio(s1, n)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.greatest(ratio(spread, n - 1), F.lit(0.0)))


def skewness_of(n: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """Population skewness from raw sums; zero when the values are constant."""
    mu = ratio(s1, n)
    m2 = ratio(s2, n) - mu * mu
    m3 = ratio(s3, n) - 3 * mu * ratio(s2, n) + 2 * mu * mu * mu
    return F.when(m2 <= 1e-24, F.lit(0.0)).otherwise(ratio(m3, F.pow(F.greatest(m2, F.lit(1e-24)), F.lit(1.5))))


def report_rounding(df: DataFrame, digits: dict[str, int] | int = 6) -> DataFrame:
    """Round double columns to nearest, ties to even, for printed reports."""
    def digits_for(name: str) -> int | None:
        return digits if isinstance(digits, int) else digits.get(name)

    return df.select(*[
        F.bround(F.col(f.name), digits_for(f.name)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) and digits_for(f.name) is not None else F.col(f.name)
        for f in df.schema.fields
    ])


def money_label(amount: Column) -> Column:
    """``~$12k`` from one thousand upwards, ``~$845`` below; halves round to even."""
    whole = lambda c: F.format_string("%d", F.bround(c, 0).cast("bigint"))
    return F.when(amount >= 1000, F.concat(F.lit("~$"), whole(amount / 1000), F.lit("k"))) \
        .otherwise(F.concat(F.lit("~$"), whole(amount)))


def count_label(count: Column) -> Column:
    """Thousands separators; ``n/a`` for a missing value."""
    return F.coalesce(F.format_number(count, 0), F.lit("n/a"))
