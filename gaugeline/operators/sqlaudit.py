"""Checks over a table of SQL texts: read-only lint, and table and column references against a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words that are not table or column names.
SQL_WORDS = (
    "SELECT", "FROM", "WHERE", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER", "FULL",
    "ON", "AND", "OR", "NOT", "IN", "LIKE", "AS", "IS", "NULL", "GROUP", "BY",
    "ORDER", "HAVING", "LIMIT", "OFFSET", "DISTINCT", "WITH", "UNION", "INTERSECT",
    "EXCEPT", "EXISTS", "CASE", "WHEN", "THEN", "ELSE", "END", "INTO", "VALUES",
    "TRUE", "FALSE", "AVG", "SUM", "COUNT", "MAX", "MIN", "COALESCE", "CAST",
    "FLOAT", "INT", "INTEGER", "VARCHAR", "TEXT", "DATE", "OVER", "PARTITION",
    "ROW", "ROWS", "UNBOUNDED", "PRECEDING", "FOLLOWING", "CURRENT",
)

# Statements that change something, and table functions that read files.
MUTATIONS = (
    r"\b(INSERT|UPDATE|DELETE|DROP|TRUNCATE|ALTER|CREATE|REPLACE|MERGE|COPY|"
    r"GRANT|REVOKE|CALL|DO|ATTACH|DETACH|EXPORT|LOAD)\b")
FILE_READS = r"\b(read_csv|read_csv_auto|read_parquet|read_json|read_json_auto|glob|read_blob|read_text)\s*\("

# A quoted literal or identifier (doubled quotes inside), a line comment, or a block comment, whichever starts first.
_LITERALS_AND_COMMENTS = r"""(?s)(['"`])(?:(?!\1).|\1\1)*+(\1|\z)|--[^\n]*|/\*.*?(?:\*/|\z)"""


def checkable(sql: Column) -> Column:
    """The statement without comments and with the bodies of literals blanked."""
    return F.regexp_replace(sql, _LITERALS_AND_COMMENTS, "$1$2")


def lint(sql: Column) -> Column:
    """``ok`` or the first reason why a statement is not a single read-only query."""
    bare = checkable(F.trim(sql))
    body = F.regexp_replace(bare, r"[;\s]+\z", "")
    says = lambda p: bare.rlike("(?i)" + p)
    return (F.when(F.coalesce(F.length(F.trim(F.regexp_replace(sql, r"\s+", " "))), F.lit(0)) == 0, "empty")
            .when(body.contains(";"), "more than one statement")
            .when(~F.regexp_replace(bare, r"\A\s+", "").rlike(r"(?i)\A(SELECT|WITH)"), "not a query")
            .when(says(MUTATIONS), "mutation").when(says(FILE_READS), "file read").otherwise("ok"))


def _all(sql: Column, pattern: str, group: int) -> Column:
    return F.transform(F.regexp_extract_all(sql, F.lit("(?i)" + pattern), F.lit(group)), lambda s: F.lower(s))


def cte_names(sql: Column) -> Column:
    return F.array_distinct(F.concat(_all(sql, r"\bWITH\s+(\w+)\s+AS\b", 1), _all(sql, r",\s*(\w+)\s+AS\s*\(", 1)))


def table_references(sql: Column) -> Column:
    """Distinct real tables behind FROM and JOIN: no CTE names, no keywords, at least three characters."""
    ctes = cte_names(sql)
    words = [w.lower() for w in SQL_WORDS]
    names = F.transform(_all(sql, r"\b(?:FROM|JOIN)\s+([\w.]+)", 1), lambda s: F.regexp_replace(s, r"\.+\z", ""))
    kept = F.filter(names, lambda s: (F.length(s) > 2) & ~s.isin(*words) & ~F.array_contains(ctes, s))
    return F.array_distinct(kept)


def _aliases(df: DataFrame, key: str, sql: str) -> DataFrame:
    """``(key, alias, table)`` of every FROM and JOIN target; a table is also its own alias."""
    text, ctes = F.col(sql), cte_names(F.col(sql))
    pieces = []
    for word in ("FROM", "JOIN"):
        pattern = rf"\b{word}\s+([\w.]+)(?:\s+(?:AS\s+)?(\w+))?"
        pieces.append(F.arrays_zip(_all(text, pattern, 1).alias("table"), _all(text, pattern, 2).alias("alias")))
    targets = df.select(key, ctes.alias("ctes"), F.explode(F.concat(*pieces)).alias("t")).select(key, "ctes", "t.table", "t.alias") \
        .where(~F.array_contains("ctes", F.col("table")))
    names = F.array_distinct(F.array(F.col("table"), F.when(F.col("alias") == "", F.col("table")).otherwise(F.col("alias"))))
    return targets.select(key, "table", F.explode(names).alias("alias")).distinct()


def unknown_tables(df: DataFrame, key: str, sql: str, catalog: DataFrame) -> DataFrame:
    """``(key, table)`` of referenced tables the catalog lacks."""
    known = catalog.select(F.lower("table").alias("table")).distinct()
    named = df.select(key, F.explode(table_references(F.col(sql))).alias("table"))
    return named.join(known, "table", "left_anti").select(key, "table")


def unknown_columns(df: DataFrame, key: str, sql: str, catalog: DataFrame) -> DataFrame:
    """``(key, alias, column, table)`` of ``alias.column`` references whose table is known but lacks the column."""
    words = [w.lower() for w in SQL_WORDS]
    text = F.col(sql)
    pattern = r"\b(\w+)\.(\w+)\b"
    pairs = F.array_distinct(F.arrays_zip(_all(text, pattern, 1).alias("alias"), _all(text, pattern, 2).alias("column")))
    refs = df.select(key, F.explode(pairs).alias("p")).select(key, "p.alias", "p.column") \
        .where((F.length("column") > 1) & ~F.col("column").isin(*words))
    columns = catalog.select(F.lower("table").alias("table"), F.lower("column").alias("column")).distinct()
    resolved = refs.join(_aliases(df, key, sql), [key, "alias"]).join(columns.select("table").distinct(), "table", "left_semi")
    return resolved.join(columns, ["table", "column"], "left_anti").select(key, "alias", "column", "table")


def outside_allowed(df: DataFrame, key: str, sql: str, allowed: DataFrame) -> DataFrame:
    """``(key, table)`` of referenced tables that are not on the allow list."""
    return unknown_tables(df, key, sql, allowed)


def usable_examples(df: DataFrame, sql: str, known_tables: list[str]) -> DataFrame:
    """Statements whose tables are all known; none at all when no table is known."""
    if not known_tables:
        return df.where(F.lit(False))
    known = F.array(*[F.lit(t.lower()) for t in known_tables])
    return df.where(F.size(F.array_except(table_references(F.col(sql)), known)) == 0)
