"""Hashed bag-of-words vectors in long form ``(id, bucket, weight)``, and dense vector arithmetic.

The long form keeps one row per occupied bucket, so long texts aggregate with a map-side combine and
similarity becomes an equi-join on buckets.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeline.functions.text import word_tokens

DIMENSIONS = 384
TOKEN_WEIGHT, PAIR_WEIGHT = 2.0, 1.0

# Words read as one canonical term.
CANONICAL_TERMS = {
    "average": "average", "avg": "average", "mean": "average",
    "breakdown": "breakdown", "breakdowns": "breakdown", "group": "breakdown", "grouped": "breakdown", "groups": "breakdown",
    "salaries": "salary", "salary": "salary", "pay": "salary", "earned": "salary", "earn": "salary", "earnings": "salary",
    "departments": "department", "department": "department", "engineering": "department", "marketing": "department",
    "customers": "customer", "customer": "customer",
    "users": "user", "user": "user", "dau": "user", "daily": "user", "active": "user",
    "revenues": "revenue", "revenue": "revenue", "sales": "revenue", "income": "revenue",
    "forecast": "weather", "weather": "weather", "rain": "weather", "temperatures": "weather", "temperature": "weather",
    "umbrella": "weather",
    "patient": "health", "patients": "health", "readmission": "health", "readmissions": "health", "diabetes": "health",
    "cohort": "health", "cohorts": "health",
    "android": "android", "analyse": "analyze", "analyze": "analyze",
}

# Words left out of the vectors.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from",
    "had", "has", "have", "i", "in", "is", "it", "me", "of", "on", "or",
    "per", "please", "show", "should", "the", "this", "to", "was", "were",
    "what", "with",
)


def canonical_tokens(text: Column) -> Column:
    """Tokens without plural endings and stop words, in canonical wording."""
    canonical = F.create_map(*[F.lit(x) for x in chain.from_iterable(CANONICAL_TERMS.items())])
    singular = F.transform(word_tokens(text), lambda t: F.when(
        (F.length(t) > 3) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    kept = F.filter(singular, lambda t: ~t.isin(*STOPWORDS) & (t != ""))
    return F.transform(kept, lambda t: F.concat(F.lit("tok:"), F.when(t.isin(*CANONICAL_TERMS), F.try_element_at(canonical, t)).otherwise(t)))


def neighbour_pairs(tokens: Column) -> Column:
    """Names of adjacent token pairs."""
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), rest), F.slice(tokens, F.lit(2), rest),
                      lambda a, b: F.concat(F.lit("bigram:"), a, F.lit(":"), b))


def weighted_features(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per occurrence: ``(*keys, feature, weight)``. Tokens are computed once per text and read twice."""
    tokens = df.select(*keys, canonical_tokens(F.col(text)).alias("_tokens"))
    both = tokens.select(*keys, F.explode(F.concat("_tokens", neighbour_pairs(F.col("_tokens")))).alias("feature"))
    return both.withColumn("weight", F.when(F.col("feature").startswith("tok:"), TOKEN_WEIGHT).otherwise(PAIR_WEIGHT))


def bucket_of(feature: Column) -> Column:
    return (F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("bigint") % DIMENSIONS).cast("int")


def bucket_weights(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Raw weight per key and bucket, not normalised."""
    found = weighted_features(df, keys, text).withColumn("bucket", bucket_of(F.col("feature")))
    return found.groupBy(*keys, "bucket").agg(F.sum("weight").alias("weight"))


def embed(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Unit vectors in long form. A key holds at most 384 rows, which bounds the window."""
    raw = bucket_weights(df, keys, text)
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(*keys)))
    return raw.withColumn("weight", F.col("weight") / norm)


def packed(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with the occupied ``buckets`` and their ``weights`` (at most 384 entries are gathered per key)."""
    entries = vectors.groupBy(*keys).agg(F.collect_list(F.struct("bucket", "weight")).alias("_e"))
    return entries.select(*keys, F.col("_e.bucket").alias("buckets"), F.col("_e.weight").alias("weights"))


def matrix(buckets, weights) -> np.ndarray:
    """Arrow lists of buckets and weights as rows of a matrix; a null list is a row of zeros."""
    sizes = np.nan_to_num(buckets.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    out = np.zeros((len(sizes), DIMENSIONS))
    out[np.repeat(np.arange(len(sizes)), sizes), buckets.flatten().to_numpy(zero_copy_only=False)] = weights.flatten().to_numpy(zero_copy_only=False)
    return out


def _filled(element: str):
    """Column function: packed vectors as arrays of all 384 positions."""
    @F.arrow_udf(f"array<{element}>")
    def filled(buckets: pa.Array, weights: pa.Array) -> pa.Array:
        values = matrix(buckets, weights).astype(np.float32 if element == "float" else np.float64)
        return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * DIMENSIONS, pa.array(values.ravel()))

    return filled


def dense(vectors: DataFrame, keys: list[str], element: str = "float") -> DataFrame:
    """Fixed-length arrays of ``float`` or ``double`` from long vectors."""
    return packed(vectors, keys).select(*keys, _filled(element)("buckets", "weights").alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b)), F.lit(0.0))


def pair_cosine(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Cosine of two texts on the same row: both sides aggregate together, one shuffle by key."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col(left).alias("text")), F.struct(F.lit(1).alias("side"), F.col(right).alias("text")))
    both = bucket_weights(pairs.select(key, F.explode(sides).alias("s")).select(key, "s.side", "s.text"), [key, "side"], "text")
    per_bucket = both.groupBy(key, "bucket").agg(*[
        F.sum(F.when(F.col("side") == i, F.col("weight")).otherwise(0.0)).alias(n) for i, n in enumerate(("a", "b"))])
    norms = F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))
    return per_bucket.groupBy(key).agg(F.coalesce(F.try_divide(F.sum(F.col("a") * F.col("b")), norms), F.lit(0.0)).alias("relevancy"))
