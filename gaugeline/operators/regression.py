"""Least-squares regression from one pass of covariances, or of triangular factors; the small solve runs on the result row."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.functions import prob
from gaugeline.functions.names import numeric_columns, text_columns
from gaugeline.functions.numbers import as_double
from gaugeline.operators import leastsq
from gaugeline.operators.explore import highest_variance_column
from gaugeline.operators.quantiles import quantiles

MAX_FEATURES, MAX_LEVELS, VIF_LIMIT, NARROW = 15, 10, 10.0, 6
#: smallest against largest eigenvalue of the correlations down to which covariances are used
CONDITION = 1e-5
COEFFICIENTS = ("target string, n_obs bigint, n_features int, feature string, coefficient double, std_err double, t_stat double, "
                "p_value double, ci_lower double, ci_upper double, significant boolean, vif double, r_squared double, "
                "adj_r_squared double, f_stat double, f_pvalue double, collinear_dropped string")


def select_target(df: DataFrame, hint: str = "") -> str | None:
    """The longest numeric column named in the hint (underscores read as spaces), else the most variable one."""
    numbers = numeric_columns(df)
    hint = hint.lower()
    spaced = hint.replace("_", " ")
    named = [c for c in numbers if hint and (c.lower() in hint or c.lower().replace("_", " ") in spaced)]
    if named:
        return max(named, key=len)
    return highest_variance_column(df, numbers) if numbers else None


@dataclass(frozen=True)
class Features:
    names: list[str]
    columns: list[Column]


def feature_columns(df: DataFrame, target: str) -> Features:
    """Numeric columns (nulls become the median) and one-hot columns of texts with 2..10 values (nulls become the mode).

    The first level of each text is the reference level. Constant columns drop out and the
    fifteen most variable ones stay.
    """
    numbers = [c for c in numeric_columns(df) if c != target]
    texts = [c for c in text_columns(df) if c != target]
    probe = df.agg(*[F.count_if(as_double(c).isNull()).alias(f"null_{c}") for c in numbers],
                   *[F.approx_count_distinct(c).alias(f"n_{c}") for c in texts],
                   F.count(F.lit(1)).alias("rows")).first() if numbers + texts else None
    names, columns = [], []
    for c in numbers:
        x = as_double(c)
        if probe[f"null_{c}"] and probe[f"null_{c}"] < probe["rows"]:
            x = F.coalesce(x, F.lit(quantiles(df, c, [0.5]).first()["quantiles"][0]))
        names.append(c)
        columns.append(x)
    for c in [c for c in texts if probe[f"n_{c}"] <= 2 * MAX_LEVELS]:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).count().limit(4 * MAX_LEVELS).collect()
        if not 2 <= len(counts) <= MAX_LEVELS:
            continue
        most = min(counts, key=lambda r: (-r["count"], r[c]))[c]
        filled = F.coalesce(F.col(c), F.lit(most))
        for level in sorted(r[c] for r in counts)[1:]:
            names.append(f"{c}_{level}")
            columns.append(F.when(filled == level, 1.0).otherwise(0.0))
    if not names:
        return Features([], [])
    spread: list[float | None] = []
    for at in range(0, len(columns), 12):
        spread += list(df.agg(*[F.var_samp(x).alias(str(i)) for i, x in enumerate(columns[at:at + 12])]).first())
    kept = [i for i in range(len(names)) if spread[i] is not None and spread[i] > 0]
    if len(kept) > MAX_FEATURES:
        kept = sorted(kept, key=lambda i: (-spread[i], i))[:MAX_FEATURES]
    return Features([names[i] for i in kept], [columns[i] for i in kept])


def _well_conditioned(cov: np.ndarray) -> bool:
    """Covariances lose as many digits as the condition of their correlations has; the rest is left to the triangular factor."""
    spread = np.sqrt(np.diag(cov))
    if not np.all(spread > 0) or not np.all(np.isfinite(cov)):
        return False
    values = np.linalg.eigvalsh(cov / np.outer(spread, spread))
    return values[0] > CONDITION * values[-1]


def _from_covariances(n: int, cov: np.ndarray) -> leastsq.Fit:
    sxx, sxy, syy = cov[:-1, :-1], cov[:-1, -1], cov[-1, -1]
    inverse = np.linalg.inv(sxx)
    beta = inverse @ sxy
    return leastsq.Fit(list(range(len(sxx))), beta, inverse / (n - 1), np.diag(sxx) * (n - 1), max((syy - beta @ sxy) * (n - 1), 0.0), syy * (n - 1))


def _covariances(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Row count and sample covariances of the columns ``x0…``.

    Few columns are plain aggregates. Wider ones go through the vector summaries of the ML library, which keep
    one packed matrix per task.
    """
    if width <= NARROW:
        pairs = [(i, j) for i in range(width) for j in range(i, width)]
        stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
        cov = np.zeros((width, width))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = stats[f"c{i}_{j}"] or 0.0
        return stats["n"], cov
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(width)], outputCol="v").transform(rows).select("v")
    facts = vectors.select(Summarizer.metrics("count", "variance").summary(F.col("v")).alias("s")).select("s.*").first()
    if facts["count"] < 2:
        return facts["count"], np.zeros((width, width))
    spread = np.sqrt(facts["variance"].toArray())
    return facts["count"], np.nan_to_num(Correlation.corr(vectors, "v").first()[0].toArray()) * np.outer(spread, spread)


def regress(df: DataFrame, target: str | None = None, hint: str = "") -> DataFrame:
    """Coefficient rows of the least-squares fit, strongest first, with fit quality and variance inflation on each row.

    The data is reduced to covariances of at most 16 columns, or, where those are too nearly dependent to be trusted, to a
    triangular factor of the same size; the solve runs on that.
    """
    target = target or select_target(df, hint)
    if target is None or target not in df.columns:
        raise ValueError("no usable target column found")
    features = feature_columns(df, target)
    k = len(features.names)
    if k == 0:
        raise ValueError("no feature columns available after encoding")
    named = [x.alias(f"x{i}") for i, x in enumerate(features.columns)] + [as_double(target).alias(f"x{k}")]
    n, cov = _covariances(df.where(as_double(target).isNotNull()).select(*named), k + 1)
    if n < max(10, k + 2):
        raise ValueError(f"only {n} observations for {k} features")
    usable = df.where(as_double(target).isNotNull()).select(*named)
    solved = _from_covariances(n, cov) if _well_conditioned(cov[:k, :k]) else leastsq.fit(leastsq.triangular_factor(usable)[1])
    kept, beta, inverse, rss, tss = solved.kept, solved.beta, solved.inverse, solved.rss, solved.tss
    dropped = ",".join(features.names[i] for i in range(k) if i not in kept)
    p = len(kept)
    dof = n - p - 1
    r2 = 1.0 - rss / tss if tss > 1e-12 else 0.0
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / dof if dof > 0 else r2
    std_err = np.sqrt(np.diag(inverse) * rss / dof)
    crit = prob.t_ppf(0.975, dof)
    r2, adjusted = float(r2), float(adjusted)
    f_stat = (r2 / p) / ((1.0 - r2) / dof) if tss > 1e-12 and 1.0 - r2 > 1e-12 else None
    f_p = prob.f_sf(f_stat, p, dof) if f_stat is not None else None
    vif = np.diag(inverse) * solved.lengths if p >= 2 else np.full(p, np.nan)
    out = []
    for i, at in enumerate(kept):
        b, s = float(beta[i]), float(std_err[i])
        t = b / s if s > 0 else None
        p_value = 2.0 * prob.t_sf(abs(t), dof) if t is not None else None
        out.append((target, n, p, features.names[at], b, s, t, p_value, b - crit * s, b + crit * s,
                    p_value is not None and p_value < 0.05, None if math.isnan(vif[i]) else float(vif[i]), r2, adjusted,
                    f_stat, f_p, dropped))
    out.sort(key=lambda r: -(abs(r[6]) if r[6] is not None else 0.0))
    return df.sparkSession.createDataFrame(out, COEFFICIENTS)


def inflated_features(coefficients: DataFrame, limit: float = VIF_LIMIT) -> DataFrame:
    return coefficients.where(F.col("vif") > limit).select("feature", "vif")
