"""Probability functions of plain numbers, for values that the driver holds; :mod:`gaugeline.functions.tails` has them for columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_STANDARD = NormalDist()
_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 1_000_000):  # about the square root of the larger parameter is needed
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def _log_gamma_step(a: float, b: float) -> float:
    """ln Gamma(a + b) - ln Gamma(a). For large a the difference of two Stirling series, which loses no digits."""
    if a < 50.0:
        return math.lgamma(a + b) - math.lgamma(a)
    c = a + b
    rest = sum(k * (c ** -p - a ** -p) for k, p in ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7)))
    return (a - 0.5) * math.log1p(b / a) + b * math.log(c) - b + rest


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function. ``y`` is 1 - x, given where x is so near 1 that the difference loses digits."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    step = _log_gamma_step(a, b) - math.lgamma(b) if a >= b else _log_gamma_step(b, a) - math.lgamma(a)
    front = math.exp(step + a * (math.log1p(-y) if y < 0.5 else math.log(x)) + b * (math.log1p(-x) if x < 0.5 else math.log(y)))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b, c = x + 1.0 - a, 1.0 / _TINY
    d = 1.0 / b
    value = d
    for i in range(1, 10000):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / ((step * d + b) or _TINY)
        c = (b + step / c) or _TINY
        value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * value


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_ppf(q: float) -> float:
    return _STANDARD.inv_cdf(q)


def t_sf(t: float, dof: float) -> float:
    """Upper tail of Student's t, by the same formula at all degrees of freedom."""
    tail = 0.5 * betainc(dof / 2.0, 0.5, dof / (dof + t * t), t * t / (dof + t * t))
    return tail if t >= 0 else 1.0 - tail


def t_ppf(q: float, dof: float) -> float:
    """Quantile of Student's t by bisection on the upper tail."""
    if q == 0.5:
        return 0.0
    if q < 0.5:
        return -t_ppf(1.0 - q, dof)
    low, high = 0.0, 2.0
    while t_sf(high, dof) > 1.0 - q and high < 1e12:
        low, high = high, high * 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        if t_sf(mid, dof) > 1.0 - q:
            low = mid
        else:
            high = mid
        if high - low <= 1e-14 * max(1.0, high):
            break
    return 0.5 * (low + high)


def chi2_sf(x: float, dof: float) -> float:
    return gammainc_upper(dof / 2.0, x / 2.0)


def f_sf(x: float, d1: float, d2: float) -> float:
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * x), d1 * x / (d2 + d1 * x)) if x > 0 else 1.0


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(600)


def nct_cdf(t: float, dof: float, nc: float) -> float:
    """Non-central t: the normal probability averaged over the chi-distributed scale."""
    width = 12.0 / math.sqrt(2.0 * dof)
    low, high = max(1e-12, 1.0 - width), 1.0 + width
    s = 0.5 * (high - low) * _NODES + 0.5 * (high + low)
    log_density = (dof - 1.0) * np.log(s) - dof * (s * s - 1.0) / 2.0
    weight = _WEIGHTS * np.exp(log_density - log_density.max())
    inner = np.array([norm_sf(nc - t * v) for v in s])
    return float((weight * inner).sum() / weight.sum())


def post_hoc(ncp: float, dof: float, alpha: float) -> float:
    """Two-sided power of a t-test with the given non-centrality."""
    critical = t_ppf(1.0 - alpha / 2.0, dof)
    return 1.0 - nct_cdf(critical, dof, ncp) + nct_cdf(-critical, dof, ncp)
