"""Approximate nearest neighbours by largest inner product, on shifted Hilbert curves.

Vectors are scaled by the largest length and given one more coordinate that makes all lengths one; queries are scaled to
length one, so the largest inner product is the nearest point. For each curve the points are projected on a few seeded
orthogonal directions, shifted, and put on a Hilbert curve. Each ordering is cut into blocks of about equal size at
quantiles of the keys; a query sees its own block and both neighbours, its window of the curve. In every window the exact
inner products decide, and the best of all windows are merged.

Every row is indexed. Equal vectors are one point, so copies neither fill a window nor a task. The window grows with the
square root of the number of points. The share of neighbours that one curve finds then still falls, about with the fourth root
of the number of points for vectors without structure, so beyond ``STEADY`` points the number of curves grows with that root.
Measured recall is in the README.

Defined results: vectors that are null, zero, of another than the most frequent length, or hold null or non-finite
components take no part, nor do rows without an id; a query of that kind has no rows. Rows equal in id and vector count once.
Ties go to smaller ids. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeline.llm.common import Scratch

#: curves for up to ``STEADY`` points
CURVES = 40
STEADY = 100_000
DIRECTIONS = 10
BITS = 5
#: a block holds ``width`` times the square root of the number of points, and a query sees three
WIDTH = 1.7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n, dims), non-negative integers below 2**bits.

    Axes are turned into the curve's transposed index by the known bit exchanges, for all rows at once, and the index's
    bits are then laced together, most significant first. dims * bits must be at most 62.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curves_for(points: int) -> int:
    """Number of curves that keeps the recall of ``STEADY`` points."""
    return int(np.ceil(CURVES * max(1.0, points / STEADY) ** 0.25))


class Curves:
    """Seeded projections and shifts of all curves."""

    def __init__(self, dims: int, longest: float, curves: int, seed: int):
        rng = np.random.default_rng(seed)
        self.longest, self.directions = longest, min(DIRECTIONS, dims + 1)
        self.base = [np.linalg.qr(rng.normal(size=(dims + 1, self.directions)))[0] for _ in range(curves)]
        self.shift = rng.random((curves, self.directions)) / 4
        self.reach = 3.6 / np.sqrt(dims + 1)

    def keys(self, x: np.ndarray, query: bool, tie: np.ndarray) -> np.ndarray:
        """Keys (rows, curves); the lowest twelve bits settle equal places."""
        if query:
            x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        else:
            x = x / self.longest
            x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])
        out = np.empty((len(x), len(self.base)), dtype=np.int64)
        for c, base in enumerate(self.base):
            y = ((x @ base / self.reach + 1) / 2 + self.shift[c]) / 1.25
            cells = np.clip((y * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            out[:, c] = (hilbert_keys(cells, BITS) << 12) | (((tie * 2654435761 + c * 40503) >> 7) & 4095)
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def nearest(embeddings: DataFrame, query: Column, k: int = 20, curves: int | None = None, width: float = WIDTH, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``query`` (on vec_id) holds; ``curves`` follows from the number of points if not given."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = common.d
    rows = rows.filter(F.size("v") == dims).distinct()
    points = scratch.keep(rows.groupBy("v").agg(F.min("vec_id").alias("point"), F.max(query).alias("asks")))
    members = scratch.keep(rows.join(points, "v").select("point", "vec_id"))
    facts = points.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).first()
    curves = curves or curves_for(facts.n)
    shape = Curves(dims, float(facts.longest), curves, seed)
    blocks = max(1, int(facts.n / (width * np.sqrt(facts.n) + k)))

    def keyed(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"keys": shape.keys(_matrix(frame["v"]), False, frame["point"].to_numpy()).tolist()})

    # one row per curve: its block borders, about the square root of the number of points
    cuts = [(i + 1) / blocks for i in range(blocks - 1)]
    borders = np.zeros((curves, len(cuts)), dtype=np.int64)
    if cuts:
        for r in (points.select("point", "v").mapInPandas(keyed, "keys array<long>").select(F.posexplode("keys").alias("curve", "key"))
                  .groupBy("curve").agg(F.percentile_approx("key", cuts, max(10_000, 10 * blocks)).alias("borders")).collect()):
            borders[r.curve] = r.borders

    def dealt(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, point = _matrix(frame["v"]), frame["point"].to_numpy()
            asks = np.flatnonzero(frame["asks"].to_numpy(dtype=bool))
            raw = np.array([v.tobytes() for v in x], dtype=object)
            own = shape.keys(x, False, point)
            asked = shape.keys(x[asks], True, point[asks]) if len(asks) else None
            for c in range(curves):
                yield pd.DataFrame({"curve": c, "block": np.searchsorted(borders[c], own[:, c]), "asks": False, "point": point, "v": raw})
                if len(asks):
                    b = np.searchsorted(borders[c], asked[:, c])
                    for step in (-1, 0, 1):
                        there = (b + step >= 0) & (b + step < blocks)
                        yield pd.DataFrame({"curve": c, "block": (b + step)[there], "asks": True, "point": point[asks][there], "v": raw[asks][there]})

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        values = np.frombuffer(b"".join(frame["v"]), dtype=np.float64).reshape(-1, dims)
        point = frame["point"].to_numpy()
        order = np.flatnonzero(~asks)
        order = order[np.argsort(point[order])]
        out, x, ids = [], values[order], point[order]
        if len(order):
            for i in np.array_split(np.flatnonzero(asks), max(1, int(asks.sum()) // 256)):
                if not len(i):
                    continue
                # einsum sums a pair's products in the same order in every window
                score = np.einsum("ij,kj->ik", values[i], x, optimize=False)
                take = min(k + 1, len(order))
                top = np.argsort(-score, axis=1, kind="stable")[:, :take]
                out.append(pd.DataFrame({"q": np.repeat(point[i], take), "point": ids[top].ravel(), "score": np.take_along_axis(score, top, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"q": pd.Series(dtype="int64"), "point": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = points.mapInPandas(dealt, "curve int, block int, asks boolean, point long, v binary").groupBy("curve", "block").applyInPandas(best, "q long, point long, score double")
    rank = lambda keys, ids: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), ids))
    merged = found.groupBy("q", "point").agg(F.max("score").alias("score"))
    merged = scratch.keep(merged.withColumn("r", rank(["q"], "point")).filter(F.col("r") <= k + 1).drop("r"))
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("point").orderBy("vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    lists = merged.join(few, "point").withColumn("r", rank(["q"], "vec_id")).filter(F.col("r") <= k + 1).select("q", "vec_id", "score")
    queries = members.filter(query).select(F.col("point").alias("q"), F.col("vec_id").alias("query_id")).distinct()
    shown = queries.join(lists, "q").filter("query_id <> vec_id").withColumn("rank", rank(["query_id"], "vec_id")).filter(F.col("rank") <= k)
    return shown.select("query_id", "rank", "vec_id", "score")
