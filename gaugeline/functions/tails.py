"""Distribution functions as column expressions: no result row leaves the JVM for a p-value.

Continued fractions and sums are folds over sequences as long as they need to be. A fold stops changing once it has converged.
Nulls and not-a-number stay null. :mod:`gaugeline.functions.prob` has the same functions for plain numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

_EPS = 1e-15


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lets(values: list[Column], then: Callable[..., Column]) -> Column:
    """``then`` of several values; null if one of them is null or not a number."""
    clean = [F.nullif(v.cast("double"), F.lit(float("nan"))) for v in values]
    named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(clean)])
    known = clean[0].isNotNull()
    for v in clean[1:]:
        known = known & v.isNotNull()
    return F.when(known, let(named, lambda s: then(*[s[f"v{i}"] for i in range(len(values))])))


def _column(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


#: step of the trapezoid sum for erfc; its error is about exp(-(pi / step) ** 2)
_STEP = 0.5


def _erfc_positive(x: Column) -> Column:
    """Trapezoid sum of the integral form, with the residue of its pole; all terms are positive, so small tails keep their digits."""
    terms = sum((F.lit(math.exp(-((k - 0.5) * _STEP) ** 2)) / (F.lit(((k - 0.5) * _STEP) ** 2) + x * x) for k in range(1, 15)), F.lit(0.0))
    pole = F.when(x < math.pi / _STEP, 2.0 / (1.0 + F.exp(F.lit(2 * math.pi / _STEP) * x))).otherwise(0.0)
    return F.lit(2 * _STEP / math.pi) * x * F.exp(-x * x) * terms + pole


def erfc(x: Column) -> Column:
    return lets([_column(x)], lambda v: let(_erfc_positive(F.abs(v)), lambda t: F.when(v < 0, 2.0 - t).otherwise(t)))


def norm_sf(z: Column) -> Column:
    return 0.5 * erfc(_column(z) / math.sqrt(2.0))


def z_two_sided(z: Column) -> Column:
    return erfc(F.abs(_column(z)) / math.sqrt(2.0))


#: below this the gamma recurrence is used to get into the range of Stirling's series
_SHIFT = 50


def _series(x: Column) -> Column:
    """The part of Stirling's series behind (x - 1/2) ln x - x + ln(2 pi) / 2."""
    return sum((F.lit(k) / F.pow(x, F.lit(float(p))) for k, p in ((1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7))), F.lit(0.0))


def _shifted(x: Column) -> Column:
    return F.when(x < _SHIFT, F.lit(_SHIFT)).otherwise(F.lit(0))


def _steps(n: Column) -> Column:
    return F.slice(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(1), n)


def _log_gamma_step(a: Column, b: Column) -> Column:
    """ln Gamma(a + b) - ln Gamma(a), without the difference of two large numbers."""
    def at(s: Column) -> Column:
        n, u, c = s["n"], s["u"], s["u"] + b
        small = F.aggregate(_steps(n), F.lit(0.0), lambda t, i: t + F.log((a + i) / (a + b + i)))
        return small + (u - 0.5) * F.log1p(b / u) + b * F.log(c) - b + _series(c) - _series(u)
    return let(_shifted(a), lambda n: let(F.struct(n.alias("n"), (a + n).alias("u")), at))


def log_gamma(x: Column) -> Column:
    """ln Gamma of a positive number."""
    def at(n: Column) -> Column:
        small = F.aggregate(_steps(n), F.lit(0.0), lambda t, i: t + F.log(x + i))
        return let(x + n, lambda u: (u - 0.5) * F.log(u) - u + F.lit(0.5 * math.log(2 * math.pi)) + _series(u) - small)
    return let(_shifted(x), at)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, two terms a step, about as many steps as the root of the larger parameter."""
    first = 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("v"), F.lit(False).alias("done"))

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        term = F.when(k % 2 == 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

        def go(t: Column) -> Column:
            return let(F.struct((1.0 + t / s["c"]).alias("c"), (1.0 / (1.0 + t * s["d"])).alias("d")), lambda n: F.struct(
                n["c"].alias("c"), n["d"].alias("d"), (s["v"] * n["c"] * n["d"]).alias("v"), ((k % 2 == 1) & (F.abs(n["c"] * n["d"] - 1.0) < _EPS)).alias("done")))
        return F.when(s["done"], s).otherwise(let(term, go))

    most = F.least(F.lit(2_000_000), 400 + 20 * F.ceil(F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(F.sequence(F.lit(2), most), start, step, lambda s: s["v"])


def _betainc(a: Column, b: Column, x: Column, y: Column) -> Column:
    step = F.when(a >= b, _log_gamma_step(a, b) - log_gamma(b)).otherwise(_log_gamma_step(b, a) - log_gamma(a))
    log_x = F.when(y < 0.5, F.log1p(-y)).otherwise(F.log(x))
    log_y = F.when(x < 0.5, F.log1p(-x)).otherwise(F.log(y))
    front = F.exp(step + a * log_x + b * log_y)
    inner = F.when(x < (a + 1.0) / (a + b + 2.0), front * _beta_fraction(a, b, x) / a).otherwise(1.0 - front * _beta_fraction(b, a, y) / b)
    return F.when(x <= 0, 0.0).when(y <= 0, 1.0).otherwise(inner)


def betainc(a: Column, b: Column, x: Column, y: Column | None = None) -> Column:
    """Regularised incomplete beta function; ``y`` is 1 - x, given where x is so near 1 that the difference loses digits."""
    x = _column(x)
    return lets([_column(a), _column(b), x, 1.0 - x if y is None else y], _betainc)


def gammainc_upper(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    def at(a: Column, x: Column) -> Column:
        front = F.exp(a * F.log(x) - x - log_gamma(a))
        most = F.least(F.lit(2_000_000), 200 + 20 * F.ceil(F.sqrt(F.greatest(a, x))).cast("int"))
        one = 1.0 / a
        low = F.aggregate(F.sequence(F.lit(1), most), F.struct(one.alias("t"), one.alias("v")), lambda s, k: F.when(s["t"] <= s["v"] * 1e-17, s).otherwise(
            let(s["t"] * x / (a + k), lambda t: F.struct(t.alias("t"), (s["v"] + t).alias("v")))), lambda s: s["v"])

        def step(s: Column, i: Column) -> Column:
            k = i.cast("double")
            b, t = x + 1.0 - a + 2.0 * k, -k * (k - a)
            return F.when(s["done"], s).otherwise(let(F.struct((b + t / s["c"]).alias("c"), (1.0 / (t * s["d"] + b)).alias("d")), lambda n: F.struct(
                n["c"].alias("c"), n["d"].alias("d"), (s["v"] * n["c"] * n["d"]).alias("v"), (F.abs(n["c"] * n["d"] - 1.0) < _EPS).alias("done"))))
        first = 1.0 / (x + 1.0 - a)
        start = F.struct(F.lit(1e300).alias("c"), first.alias("d"), first.alias("v"), F.lit(False).alias("done"))
        high = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["v"])
        return F.when(x <= 0, 1.0).when(x < a + 1.0, 1.0 - front * low).otherwise(front * high)
    return lets([_column(a), _column(x)], at)


def t_sf(t: Column, dof: Column) -> Column:
    """Upper tail of Student's t, by the same formula at all degrees of freedom."""
    def at(t: Column, dof: Column) -> Column:
        half = 0.5 * betainc(dof / 2.0, F.lit(0.5), dof / (dof + t * t), t * t / (dof + t * t))
        return let(half, lambda p: F.when(t >= 0, p).otherwise(1.0 - p))
    return lets([_column(t), _column(dof)], at)


def t_two_sided(t: Column, dof: Column) -> Column:
    return 2.0 * t_sf(F.abs(_column(t)), dof)


def t_ppf(q: Column, dof: Column) -> Column:
    """Quantile of Student's t by Newton's method; the upper tail is convex, so that it rises to the quantile from 0."""
    def at(q: Column, dof: Column) -> Column:
        p = F.least(q, 1.0 - q)
        front = _log_gamma_step(dof / 2.0, F.lit(0.5)) - 0.5 * F.log(dof * math.pi)

        def climb(s: Column, _: Column) -> Column:
            density = F.exp(s["f"] - (dof + 1.0) / 2.0 * F.log1p(s["t"] * s["t"] / dof))
            return F.when(s["done"], s).otherwise(let((t_sf(s["t"], dof) - p) / density, lambda d: F.struct(
                (s["t"] + d).alias("t"), s["f"].alias("f"), (F.abs(d) <= 1e-15 * F.greatest(s["t"], F.lit(1e-3))).alias("done"))))
        start = F.struct(F.lit(0.0).alias("t"), front.alias("f"), F.lit(False).alias("done"))
        root = F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, climb, lambda s: s["t"])
        return F.when(q == 0.5, 0.0).when(q < 0.5, -root).otherwise(root)
    return lets([_column(q), _column(dof)], at)


def chi2_sf(x: Column, dof: Column) -> Column:
    return gammainc_upper(_column(dof) / 2.0, _column(x) / 2.0)


def f_sf(x: Column, d1: Column, d2: Column) -> Column:
    def at(x: Column, d1: Column, d2: Column) -> Column:
        return F.when(x > 0, betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * x), d1 * x / (d2 + d1 * x))).otherwise(1.0)
    return lets([_column(x), _column(d1), _column(d2)], at)


_PANELS = 60
_NODES = np.polynomial.legendre.leggauss(10)


def nct_cdf(t: Column, dof: Column, nc: Column) -> Column:
    """Non-central t: the normal probability averaged over the chi-distributed scale, by Gauss-Legendre panels that lie closer at
    small scales, where few degrees of freedom leave a sharp step."""
    def at(t: Column, dof: Column, nc: Column) -> Column:
        width = 12.0 / F.sqrt(2.0 * dof)

        def over(r: Column) -> Column:
            half = r["half"]

            def node(s: Column, root: Column, w: float) -> Column:
                def add(v: Column) -> Column:
                    weight = w * root * F.exp((dof - 1.0) * F.log(v) - dof * (v * v - 1.0) / 2.0)
                    return let(weight, lambda g: F.struct((s["p"] + g * norm_sf(nc - t * v)).alias("p"), (s["g"] + g).alias("g")))
                return let(r["low"] + r["length"] * root * root, add)

            def panel(s: Column, k: Column) -> Column:
                points = F.array(*[F.struct(F.lit(float(x + 1)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(*_NODES)])
                return F.aggregate(points, s, lambda u, n: let((k + n["x"] / 2) / _PANELS, lambda root: node(u, root, n["w"])))
            start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("g"))
            return F.aggregate(F.sequence(F.lit(0), F.lit(_PANELS - 1)), start, panel, lambda s: s["p"] / s["g"])
        low = F.greatest(F.lit(1e-12), 1.0 - width)
        return let(F.struct(low.alias("low"), (1.0 + width - low).alias("length")), over)
    return lets([_column(t), _column(dof), _column(nc)], at)


def post_hoc_power(ncp: Column, dof: Column, alpha: Column) -> Column:
    """Two-sided power of a t-test with the given non-centrality."""
    def at(ncp: Column, dof: Column, alpha: Column) -> Column:
        return let(t_ppf(1.0 - alpha / 2.0, dof), lambda c: 1.0 - nct_cdf(c, dof, ncp) + nct_cdf(-c, dof, ncp))
    return lets([_column(ncp), _column(dof), _column(alpha)], at)
