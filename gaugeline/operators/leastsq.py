"""Least squares by tall-skinny QR: one triangular factor per task, merged in a tree.

The factor of [1, X, y] holds all that a regression needs, and unlike covariances it does not square the condition of the
table: columns that agree in ten digits still give coefficients. A task keeps one square factor and passes on one; factors are
merged within salted groups and then all together, so the last task reads about the square root of the number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: a column whose part outside the ones before it is below this share of its length counts as their combination
COLLINEAR = 1e-11


def _factored(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r")


def triangular_factor(numbers: DataFrame) -> tuple[int, np.ndarray]:
    """Row count and R of [1, columns…] over all rows of a table of doubles without nulls."""
    width = len(numbers.columns) + 1

    def local(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        r, rows = np.zeros((0, width)), 0
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns]])
            r, rows = _factored(np.vstack([r, x])), rows + len(x)
        if rows:
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([rows], pa.int64()),
                                              "r": pa.array([r.astype("<f8").tobytes()], pa.binary())})

    def merge(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, rows = np.zeros((0, width)), 0
        for frame in frames:
            for n, data in zip(frame["n"], frame["r"]):
                r, rows = _factored(np.vstack([r, np.frombuffer(data, dtype="<f8").reshape(-1, width)])), rows + int(n)
        if rows:
            yield pd.DataFrame({"task": [0], "n": [rows], "r": [r.astype("<f8").tobytes()]})

    schema = "task int, n bigint, r binary"
    factors = numbers.mapInArrow(local, schema)
    groups = math.ceil(math.sqrt(max(1, numbers.rdd.getNumPartitions())))
    last = factors.repartition(groups, F.col("task") % groups).mapInPandas(merge, schema).coalesce(1).mapInPandas(merge, schema).collect()
    return (last[0]["n"], np.frombuffer(last[0]["r"], dtype="<f8").reshape(-1, width)) if last else (0, np.zeros((0, width)))


@dataclass(frozen=True)
class Fit:
    kept: list[int]
    beta: np.ndarray
    inverse: np.ndarray
    lengths: np.ndarray
    rss: float
    tss: float


def fit(r: np.ndarray) -> Fit:
    """Coefficients from R of [1, X, y]; features that combine those before them are left out.

    ``inverse`` is that of the centred cross products, ``lengths`` the centred sums of squares, of the kept features.
    """
    k = r.shape[1] - 2
    centred = np.zeros((k + 1, k + 1))
    centred[:min(len(r) - 1, k + 1)] = r[1:k + 2, 1:]
    kept: list[int] = []
    for j in range(k):
        trial = _factored(centred[:, [*kept, j]])
        if len(trial) > len(kept) and abs(trial[len(kept), len(kept)]) > COLLINEAR * np.linalg.norm(r[:, j + 1]):
            kept.append(j)
    p, small = len(kept), _factored(centred[:, [*kept, k]])
    small = np.vstack([small, np.zeros((max(p + 1 - len(small), 0), p + 1))])
    root = np.linalg.inv(small[:p, :p]) if p else np.zeros((0, 0))
    return Fit(kept, np.linalg.solve(small[:p, :p], small[:p, p]) if p else np.zeros(0), root @ root.T, (small[:p, :p] ** 2).sum(axis=0),
               float(small[p, p] ** 2), float((small[:, p] ** 2).sum()))
