"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios, trained on labelled text.

A text is the set of its hashed character n-grams (3 to 5 lower-cased characters; a text's end counts as a character).
Each n-gram is scaled by its log-count ratio r = log((p / |p|) / (q / |q|)), where p and q count toxic and clean texts
that hold it, plus one. Logistic regression is fitted on the scaled sets. N-grams whose ratio is within ``z`` standard
errors of the mean text's carry no evidence and get no weight.

Defined results: a null text counts as empty; an empty text, or any text when labels hold fewer than two classes, scores
from the intercept alone. Repeated rows are scored one by one. Labels are never an input of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gaugeline.llm.common import Scratch, columns_of, tree_sum

SIZES = (3, 4, 5)
BITS = 20
CHUNK = 1 << 14
#: most labelled rows the classifier is fitted on (a seeded sample beyond it); scores cover every row
FIT_ROWS = 20_000
#: most n-grams with a weight, the most telling ones
FEATURES = 4096


@dataclass
class Model:
    """``weights`` by hashed n-gram (ratio times coefficient) and the intercept."""

    weights: np.ndarray
    intercept: float


def _grams(texts: list[str]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """(text number, hashed n-gram) of each start of an n-gram, for each n."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    gap = np.zeros(SIZES[-1], dtype=np.uint32)
    line = np.concatenate([x for p in points for x in (p, gap)]).astype(np.uint64) if points else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(2 * len(points)), [n for p in points for n in (len(p), len(gap))])
    inside = owner % 2 == 0
    owner = (owner // 2)[inside]
    h = np.zeros(len(line), dtype=np.uint64)
    for n in range(1, SIZES[-1] + 1):
        h = h[: len(line) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + line[n - 1:] + np.uint64(n)
        if n in SIZES:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield owner, (mixed >> np.uint64(64 - BITS)).astype(np.int64)[inside[: len(h)]]


def _distinct(texts: list[str], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, n-gram) pairs, of the chosen n-grams only if given; in order."""
    keys = []
    for owner, gram in _grams(texts):
        if chosen is not None:
            hit = np.flatnonzero(chosen[gram])
            owner, gram = owner[hit], gram[hit]
        keys.append((owner << BITS) | gram)
    both = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def _blocks(texts: pd.Series, chars: int = 400_000) -> Iterable[tuple[int, list[str]]]:
    """Rows in blocks of bounded total length (a longer text is a block of its own)."""
    block, start, size = [], 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if block and size + len(t) > chars:
            yield start, block
            block, start, size = [], i, 0
        block.append(t)
        size += len(t)
    if block:
        yield start, block


def _counts(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    total = np.zeros((2, 1 << BITS), dtype=np.int32)
    seen = np.zeros(2, dtype=np.int32)
    for frame in frames:
        y = frame["y"].to_numpy()
        for start, block in _blocks(frame["text"]):
            own = y[start: start + len(block)]
            seen += np.bincount(own, minlength=2)[:2].astype(np.int32)
            text, gram = _distinct(block)
            for c in (0, 1):
                np.add.at(total[c], gram[own[text] == c], 1)
    parts = total.reshape(2, -1, CHUNK)
    yield pd.DataFrame([(c * parts.shape[1] + k, parts[c, k].tobytes()) for c in (0, 1) for k in range(parts.shape[1])]
                       + [(-1, seen.tobytes())], columns=["chunk", "values"])


def fit(sample: DataFrame, z: float = 3.0, regularisation: float = 0.01) -> Model:
    """Fit on ``sample`` (text, y 0 or 1). What reaches the driver has a fixed size: counts by hashed n-gram."""
    spark = sample.sparkSession
    rows = {r.chunk: np.frombuffer(r["values"], dtype="<i8") for r in tree_sum(sample.mapInPandas(_counts, "chunk int, values binary"), "<i4").collect()}
    weights = np.zeros(1 << BITS, dtype=np.float64)
    seen = rows.pop(-1, np.zeros(2, np.int64))
    # without labels a text counts as clean
    base = float(np.log((seen[1] + 0.1) / (seen[0] + 1)))
    if not seen.min():
        return Model(weights, base)
    q, p = np.concatenate([rows[k] for k in sorted(rows)]).reshape(2, -1) + 1.0
    # one text of either class counts as one, so long clean texts do not make all n-grams look clean
    ratio = np.log(p / (seen[1] + 1)) - np.log(q / (seen[0] + 1))
    telling = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
    telling[(p + q) < 5] = 0
    order = np.argsort(-telling, kind="stable")[:FEATURES]
    order = np.sort(order[telling[order] >= z])
    if not len(order):
        return Model(weights, base)
    chosen = np.zeros(1 << BITS, dtype=bool)
    chosen[order] = True

    def present(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            for start, block in _blocks(frame["text"]):
                text, gram = _distinct(block, chosen)
                places = np.searchsorted(order, gram)
                cuts = np.searchsorted(text, np.arange(1, len(block)))
                yield pd.DataFrame({"y": frame["y"].iloc[start: start + len(block)].to_numpy(),
                                    "places": [x.tolist() for x in np.split(places, cuts)]})

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector  # noqa: F401  (keeps the import error of a broken ML build early)
    from pyspark.ml.linalg import Vectors, VectorUDT

    ratios = ratio[order]
    width = len(order)
    as_vector = F.udf(lambda places: Vectors.sparse(width, places, ratios[places].tolist()), VectorUDT())
    rows_in = sample.mapInPandas(present, "y int, places array<int>").select(F.col("y").cast("double").alias("label"), as_vector("places").alias("features"))
    fitted = LogisticRegression(regParam=regularisation, maxIter=25, standardization=False).fit(rows_in)
    weights[order] = ratios * fitted.coefficients.toArray()
    return Model(weights, float(fitted.intercept))


def scorer(model: Model) -> Callable:
    weights, chosen, intercept = model.weights[model.weights != 0], model.weights != 0, model.intercept
    rank = np.cumsum(chosen) - 1

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.full(len(texts), intercept)
        for start, block in _blocks(texts):
            text, gram = _distinct(block, chosen)
            out[start: start + len(block)] += np.bincount(text, weights=weights[rank[gram]], minlength=len(block))
        return pd.Series(1 / (1 + np.exp(-out)))

    return score


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS, seed: int = 7) -> DataFrame:
    """All columns of ``documents`` plus held_out, score and predicted (new columns replace old ones of these names).

    Labels are learned from rows whose crc32 remainder is not 2, at most about ``fit_rows`` of them (seeded sample).
    """
    spark = documents.sparkSession
    known = (columns_of(labels, doc_id="doc_id:long", y="toxic:int").filter("y in (0, 1)").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    scratch = Scratch(spark)
    # at most about fit_rows rows of two numbers: a proven bound for the broadcast
    sample = scratch.keep(columns_of(documents, doc_id="doc_id:long", text="text").join(F.broadcast(known), "doc_id").select("text", "y"))
    model = fit(sample)
    scratch.release(sample)
    return (documents.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", scorer(model)(F.col("text")))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(documents, labels).select("doc_id", "held_out", "score", "predicted")


def clean_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, with their columns unchanged."""
    judged = score_documents(documents.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text")), labels)
    return judged.filter("predicted = 0").select("row.*")
