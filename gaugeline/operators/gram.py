"""Masked Gram matrices: counts, sums and products of all pairs of many columns over the rows where both are present, in one scan.

A task turns its Arrow batches into a matrix X of values (missing ones zero) and a matrix M of presence, and adds up MᵀM, XᵀM,
(X²)ᵀM and XᵀX as matrix products. Values are taken relative to the first one of each column, so that large means cost no digits; partial
matrices are brought to a common origin when they are added. They travel in stripes of rows, are added within salted groups and then
per stripe, so no task and not the driver holds more than one stripe of all tasks at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gaugeline.functions.numbers import as_double

#: columns of one matrix; more are taken as pairs of halves, each pair a scan of its own columns
WIDEST = 1024
STRIPE = 64
PAIRS = "i int, j int, overlap bigint, cov double, var_i double, var_j double"


class Sums:
    """n, Σx, Σy, Σx², Σy², Σxy for rows (x) by columns (y) of pairs, relative to the origins ``a`` and ``b``."""

    __slots__ = ("a", "b", "parts")

    def __init__(self, a: np.ndarray, b: np.ndarray, parts: list[np.ndarray]):
        self.a, self.b, self.parts = a, b, parts

    def at(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        n, sx, sy, sxx, syy, sxy = self.parts
        # a column without any value has no origin yet
        da, db = np.nan_to_num(self.a - a)[:, None], np.nan_to_num(self.b - b)[None, :]
        return [n, sx + n * da, sy + n * db, sxx + 2 * da * sx + n * da * da, syy + 2 * db * sy + n * db * db, sxy + da * sy + db * sx + n * da * db]

    def add(self, other: Sums) -> None:
        a, b = np.where(np.isnan(self.a), other.a, self.a), np.where(np.isnan(self.b), other.b, self.b)
        self.parts = [x + y for x, y in zip(self.at(a, b), other.at(a, b))]
        self.a, self.b = a, b

    def packed(self) -> bytes:
        return np.concatenate([self.a, self.b, *[p.ravel() for p in self.parts]]).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, data: bytes, rows: int, columns: int) -> Sums:
        v = np.frombuffer(data, dtype="<f8")
        cells = v[rows + columns:].reshape(6, rows, columns)
        return cls(v[:rows], v[rows:rows + columns], list(cells))


def _products(width: int, first: int):
    """Sums of all batches of a task, the first ``first`` columns by all, in stripes."""
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        origin, total = np.full(width, np.nan), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            present = ~np.isnan(x)
            for c in np.flatnonzero(np.isnan(origin) & present.any(axis=0)):
                finite = x[np.isfinite(x[:, c]), c]
                origin[c] = finite[0] if len(finite) else np.nan
            x = x - np.nan_to_num(origin)
            wild = np.isinf(x)
            x[~present | wild] = 0.0
            m, left = present.astype(float), slice(0, first)
            if present.all():
                n = np.full((first, width), float(len(x)))
                sx, sxx = (np.repeat(s[:first, None], width, axis=1) for s in (x.sum(axis=0), (x * x).sum(axis=0)))
                sy, syy = (np.repeat(s[None, :], first, axis=0) for s in (x.sum(axis=0), (x * x).sum(axis=0)))
            else:
                n, sx, sxx = m[:, left].T @ m, x[:, left].T @ m, (x[:, left] ** 2).T @ m
                sy, syy = m[:, left].T @ x, m[:, left].T @ (x * x)
            if wild.any():  # infinities leave a pair without a correlation
                w = wild.astype(float)
                sxx, syy = np.where(w[:, left].T @ m > 0, np.inf, sxx), np.where(m[:, left].T @ w > 0, np.inf, syy)
            parts = [n, sx, sy, sxx, syy, x[:, left].T @ x]
            total = parts if total is None else [p + q for p, q in zip(total, parts)]
        if total is None:
            return
        task = TaskContext.get().partitionId()
        for at in range(0, first, STRIPE):
            rows = slice(at, min(at + STRIPE, first))
            data = Sums(origin[rows], origin, [p[rows] for p in total]).packed()
            yield pa.RecordBatch.from_pydict({"stripe": pa.array([at], pa.int32()), "task": pa.array([task], pa.int32()), "data": pa.array([data], pa.binary())})

    return run


def _added(width: int, first: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, Sums] = {}
        for frame in frames:
            for stripe, data in zip(frame["stripe"], frame["data"]):
                part = Sums.unpacked(data, min(STRIPE, first - stripe), width)
                if stripe in totals:
                    totals[stripe].add(part)
                else:
                    totals[stripe] = part
        for stripe, total in totals.items():
            yield pd.DataFrame({"stripe": [stripe], "task": [0], "data": [total.packed()]})

    return run


def _pair_rows(places: list[int], first: int, upper: bool):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, width = np.array(places), len(places)
        for frame in frames:
            for stripe, data in zip(frame["stripe"], frame["data"]):
                n, sx, sy, sxx, syy, sxy = Sums.unpacked(data, min(STRIPE, first - stripe), width).parts
                with np.errstate(all="ignore"):
                    cov, var_i, var_j = ((p - q / n) / (n - 1) for p, q in ((sxy, sx * sy), (sxx, sx * sx), (syy, sy * sy)))
                i, j = np.meshgrid(place[stripe:stripe + len(n)], place, indexing="ij")
                keep = (i < j) if upper else (np.arange(width)[None, :] >= first) & (i != j)
                yield pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "overlap": n[keep].astype("int64"), "cov": cov[keep],
                                    "var_i": np.where(i < j, var_i, var_j)[keep], "var_j": np.where(i < j, var_j, var_i)[keep]})

    return run


def _tile(df: DataFrame, columns: list[str], left: list[int], right: list[int]) -> DataFrame:
    """Pairs within ``left`` (no ``right``), or between the two."""
    places, first = left + right, len(left)
    numbers = df.select(*[as_double(columns[p]).alias(f"c{p}") for p in places])
    sums = numbers.mapInArrow(_products(len(places), first), "stripe int, task int, data binary")
    groups = math.ceil(math.sqrt(max(1, numbers.rdd.getNumPartitions())))
    for keys in ([F.col("stripe"), F.col("task") % groups], [F.col("stripe")]):
        sums = sums.repartition(*keys).mapInPandas(_added(len(places), first), "stripe int, task int, data binary")
    return sums.mapInPandas(_pair_rows(places, first, not right), PAIRS)


def pair_moments(df: DataFrame, columns: list[str], widest: int = WIDEST) -> DataFrame:
    """i, j (places in ``columns``, i < j), overlap, cov, var_i, var_j: sample moments over the rows where both columns are present.

    Missing are nulls and NaN. Pairs with fewer than two common rows have NaN moments, those with an infinity infinite or NaN ones.
    """
    n = len(columns)
    if n <= widest:
        return _tile(df, columns, list(range(n)), [])
    halves = [list(range(at, min(at + widest // 2, n))) for at in range(0, n, widest // 2)]
    tiles = [_tile(df, columns, a, []) for a in halves] + [_tile(df, columns, a, b) for k, a in enumerate(halves) for b in halves[k + 1:]]
    return reduce(DataFrame.unionByName, tiles)
