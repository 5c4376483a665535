"""Rules that read column and metric names. They run on the driver over schema names, or as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Words in a metric name that make a rise harmful.
INCREASE_IS_HARMFUL = (
    "optout", "churn", "error", "crash", "bounce",
    "spam", "unsubscribe", "block", "report", "latency",
)

# Words in a metric name that make a fall harmful.
DECREASE_IS_HARMFUL = (
    "retain", "retention", "dau", "mau", "wau",
    "revenue", "session", "engagement", "conversion",
    "open", "click", "active", "install",
)

# Name words of metrics with heavy tails, clipped at one percent by default.
HEAVY_TAILED = (
    "revenue", "spend", "amount", "price", "cost", "purchase",
    "ltv", "count", "cnt", "sum", "total", "gmv", "orders",
)

# Substrings of metric names that should stay within 0..1.
RATE_KEYWORDS = (
    "rate", "ctr", "cvr", "conversion", "retention", "churn",
    "open_rate", "click_rate", "bounce", "engagement_rate",
)

# Entity columns used by the fan-out checks; the panel collapse also accepts "id".
ENTITY_COLUMNS = (
    "user_id", "customer_id", "patient_id", "userid",
    "uid", "entity_id", "shipment_id",
)

# Substrings that mark a time or a group column in a summary.
TIME_KEYWORDS = ("season", "year", "month", "week", "date", "period", "quarter", "day")
GROUP_KEYWORDS = (
    "position", "pos", "team", "category", "segment", "group", "type", "tier", "region",
    "department", "dept", "division", "brand", "platform", "diagnosis", "level", "grade",
    "status", "channel", "source", "cohort", "bucket", "class", "label",
)

# Whole words that mark a time column of a general series, and name tokens of uploaded date columns.
SERIES_TIME_WORDS = ("date", "month", "week", "year", "day", "quarter", "period", "time", "dt", "timestamp")
DATE_NAME_TOKENS = ("date", "time", "day", "month", "timestamp", "ts", "dt")

_NAME_SEPARATORS = r"[_\-./]+"


def _words(name: str) -> list[str]:
    return re.split(_NAME_SEPARATORS, name.lower())


def harm_direction(metric: str) -> str:
    """Which movement of a metric is harmful: ``increase``, ``decrease`` or ``both``."""
    words = _words(metric)
    up = any(w.startswith(INCREASE_IS_HARMFUL) for w in words)
    down = any(w.startswith(DECREASE_IS_HARMFUL) for w in words)
    return "both" if up == down else ("increase" if up else "decrease")


def harm_direction_col(metric: Column) -> Column:
    """The same rule over a column of metric names."""
    words = F.split(F.lower(metric), _NAME_SEPARATORS)
    starts = lambda keys: F.exists(words, lambda w: w.rlike("^(" + "|".join(keys) + ")"))
    up, down = starts(INCREASE_IS_HARMFUL), starts(DECREASE_IS_HARMFUL)
    return F.when(up & ~down, "increase").when(down & ~up, "decrease").otherwise("both")


def default_winsor_pct(metric: str) -> float:
    return 0.01 if any(w in HEAVY_TAILED for w in _words(metric)) else 0.0


def default_winsor_pct_col(metric: Column) -> Column:
    """The clipping rule over a column of metric names."""
    heavy = F.arrays_overlap(F.split(F.lower(metric), _NAME_SEPARATORS), F.array(*[F.lit(w) for w in HEAVY_TAILED]))
    return F.when(heavy, 0.01).otherwise(0.0)


def is_rate_metric(name: str) -> bool:
    return any(k in name.lower() for k in RATE_KEYWORDS)


def is_rate_metric_col(name: Column) -> Column:
    return F.lower(name).rlike("|".join(RATE_KEYWORDS))


def entity_column(columns: list[str], extra: tuple[str, ...] = ()) -> str | None:
    accepted = ENTITY_COLUMNS + extra
    return next((c for c in columns if c.lower() in accepted), None)


def looks_like_date_name(name: str) -> bool:
    return any(token in DATE_NAME_TOKENS for token in name.lower().split("_"))


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order (booleans are not numeric)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def summary_dimension(columns: list[str]) -> str | None:
    """First column whose name contains a time keyword, else a group keyword."""
    for keywords in (TIME_KEYWORDS, GROUP_KEYWORDS):
        for c in columns:
            if any(k in c.lower() for k in keywords):
                return c
    return None


def series_time_column(columns: list[str]) -> str | None:
    """First column with a whole time word in its name; ``_`` counts as a word character."""
    pattern = re.compile(r"\b(" + "|".join(SERIES_TIME_WORDS) + r")\b", re.IGNORECASE)
    return next((c for c in columns if pattern.search(c)), None)


def series_metric_candidates(df: DataFrame) -> list[str]:
    """Numeric columns that are not identifiers."""
    is_id = lambda c: c.lower() in ("id", "uuid") or c.lower().endswith("_id")
    return [c for c in numeric_columns(df) if not is_id(c)]


def week_number(week: Column) -> Column:
    """1, '1', 'W1', 'week1', 'week_1' and 1.0 all read as 1; anything else is null."""
    bare = F.regexp_replace(F.lower(F.trim(week.cast("string"))), r"^(week_|week|w)", "")
    whole = bare.try_cast("double")
    return F.when(whole == F.floor(whole), F.floor(whole).try_cast("int"))


def week_number_or_error(week: Column) -> Column:
    """As :func:`week_number`; a label that cannot be read ends the query. Null stays null."""
    number = week_number(week)
    return F.when(week.isNull() | number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("unreadable week label: "), week.cast("string"))).cast("int"))
