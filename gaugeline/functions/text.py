"""Text helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Dollar amounts, percentages and bare decimals cited in a report; years are not cited values.
CITED_NUMBER = r"(?U)\$\s*[0-9][0-9,]*(?:\.[0-9]+)?|[0-9][0-9,]*(?:\.[0-9]+)?\s*%|\b[0-9]+\.[0-9]+\b"
YEAR = r"(?U)\b(19|20)[0-9]{2}\b"
SMALL_ORDINAL = 5


def cited_numbers(text: Column) -> Column:
    """Array of the numbers a text cites, without years and without integers up to five."""
    found = F.regexp_extract_all(text, F.lit(CITED_NUMBER), F.lit(0))
    not_year = F.filter(found, lambda m: ~m.rlike(YEAR))
    bare = F.transform(not_year, lambda m: F.regexp_replace(m, r"[$%,\s]", ""))
    meant = F.filter(bare, lambda r: r.contains(".") | (r.try_cast("double") > SMALL_ORDINAL))
    return F.filter(F.transform(meant, lambda r: r.try_cast("double")), lambda v: v.isNotNull())


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def keyword_set(text: Column) -> Column:
    """Distinct lower-case alphanumeric tokens of at least three characters."""
    return F.array_distinct(F.filter(word_tokens(text), lambda t: F.length(t) >= 3))


def overlap_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def missing_elements(expected: Column, found: Column) -> Column:
    return F.array_except(expected, found)


def one_line(text: Column) -> Column:
    """Lower case with runs of white space collapsed: the form in which statements are compared."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
