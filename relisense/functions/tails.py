"""Tails of distributions as column expressions, for tables with a row per test.

Series and continued fractions run in ``aggregate`` over a fixed number of steps, and stand
still once they have settled, so a whole family of tests gets its p-values in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from relisense.functions.columns import as_col

#: Steps of a series or a continued fraction; enough for shapes up to LARGE.
STEPS = 1200
#: Degrees of freedom beyond which Student's tail is taken from the normal one by Hill's expansion.
LARGE = 100_000
#: Differences up to which the signed-rank test is exact.
EXACT_MAX = 50
_TINY, _SETTLED = 1e-300, 1e-15


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), in which value is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series ten places further up."""

    def series(y: Column) -> Column:
        terms = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
        total = F.lit(0.0)
        for k, c in enumerate(terms):
            total = total + F.lit(c) / F.pow(y, 2 * k + 1)
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + total

    climb = F.lit(1.0)
    for k in range(10):
        climb = climb * (x + k)
    return let(x + 10, series) - F.log(climb)


def _apart(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, _TINY).otherwise(x)


def _steps(begin: Column, step: Callable[[Column, Column], Column], done: Callable[[Column], Column]) -> Column:
    """A fold over STEPS numbers that stands still once the state's ``on`` is false."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, lambda s, i: F.when(s["on"], step(s, i.cast("double"))).otherwise(s), done)


def gamma_q(a: Column | float, x: Column) -> Column:
    """Regularised upper incomplete gamma function."""

    def of(v: Column) -> Column:
        a, x = v["a"], v["x"]
        scale = F.exp(-x + a * F.log(x) - log_gamma(a))
        begin = F.struct((1 / a).alias("term"), (1 / a).alias("total"), F.lit(True).alias("on"))

        def grow(s: Column, k: Column) -> Column:
            term = s["term"] * x / (a + k)
            return F.struct(term.alias("term"), (s["total"] + term).alias("total"), (term > s["total"] * 1e-17).alias("on"))

        first = F.struct((x + 1 - a).alias("b"), F.lit(1e300).alias("c"), (1 / (x + 1 - a)).alias("d"), (1 / (x + 1 - a)).alias("h"), F.lit(True).alias("on"))

        def shrink(s: Column, i: Column) -> Column:
            b = s["b"] + 2
            return let(F.struct((1 / _apart(-i * (i - a) * s["d"] + b)).alias("d"), _apart(b + -i * (i - a) / s["c"]).alias("c"), b.alias("b")), lambda n: F.struct(n["b"].alias("b"), n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h"), (F.abs(n["c"] * n["d"] - 1) > _SETTLED).alias("on")))

        small = 1 - scale * _steps(begin, grow, lambda s: s["total"])
        return F.when(x <= 0, 1.0).when(x < a + 1, small).otherwise(scale * _steps(first, shrink, lambda s: s["h"]))

    return let(F.struct(_lit(a).cast("double").alias("a"), x.cast("double").alias("x")), of)


def beta_inc(a: Column, b: Column | float, x: Column) -> Column:
    """Regularised incomplete beta function."""

    def fraction(v: Column) -> Column:
        a, b, x = v["a"], v["b"], v["x"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
        d = 1 / _apart(1 - (a + b) * x / (a + 1))
        begin = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"), F.lit(True).alias("on"))

        def half(s: Column, top: Column) -> Column:
            new = F.struct(_apart(1 + top / s["c"]).alias("c"), (1 / _apart(1 + top * s["d"])).alias("d"))
            return let(new, lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h"), (F.abs(n["c"] * n["d"] - 1) > _SETTLED).alias("on")))

        even = lambda m: m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = lambda m: -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return front * _steps(begin, lambda s, m: let(half(s, even(m)), lambda n: half(n, odd(m))), lambda s: s["h"])

    def of(v: Column) -> Column:
        turned = v["x"] > (v["a"] + 1) / (v["a"] + v["b"] + 2)
        put = F.struct(F.when(turned, v["b"]).otherwise(v["a"]).alias("a"), F.when(turned, v["a"]).otherwise(v["b"]).alias("b"), F.when(turned, 1 - v["x"]).otherwise(v["x"]).alias("x"))
        inside = let(put, fraction)
        return F.when(v["x"] <= 0, 0.0).when(v["x"] >= 1, 1.0).when(turned, 1 - inside).otherwise(inside)

    return let(F.struct(a.cast("double").alias("a"), _lit(b).cast("double").alias("b"), x.cast("double").alias("x")), of)


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def norm_sf2(z: Column) -> Column:
    """Two-sided tail of the normal distribution."""
    return gamma_q(0.5, z * z / 2)


def chi2_sf(x: Column, df: Column) -> Column:
    return gamma_q(df / 2, x / 2)


def t_sf2(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t; NULL without degrees of freedom."""

    def of(v: Column) -> Column:
        t, df = v["t"], v["df"]

        def hill(w: Column) -> Column:
            z, b = w["z"], w["b"]
            z3, z5, z7 = z * z * z, F.pow(z, F.lit(5)), F.pow(z, F.lit(7))
            return norm_sf2(z + (z3 + 3 * z) / b - (4 * z7 + 33 * z5 + 240 * z3 + 855 * z) / (10 * b * (b + 0.8 * z3 * z + 100)))

        far = let(F.struct(F.sqrt((df - 0.5) * F.log1p(t * t / df)).alias("z"), (48 * (df - 0.5) * (df - 0.5)).alias("b")), hill)
        return F.when(df > LARGE, far).when(df > 0, beta_inc(df / 2, 0.5, df / (df + t * t)))

    return let(F.struct(t.cast("double").alias("t"), df.cast("double").alias("df")), of)


def correlation_p(r: Column | str, n: Column | str, lost: int = 0) -> Column:
    """Two-sided p of a correlation over n pairs, with ``lost`` degrees of freedom for controls; NULL below one."""
    r, df = as_col(r), as_col(n) - 2 - lost
    return F.when(r.isNull() | (df < 1), F.lit(None)).when(F.abs(r) >= 1, 0.0).otherwise(t_sf2(r * F.sqrt(df / (1 - r * r)), df))


def wilcoxon_p(n: Column, w_plus: Column, tie_term: Column, ties: Column, least: int = 3) -> Column:
    """Two-sided p of the signed-rank statistic over n non-zero differences; NULL for fewer than ``least``.

    Exact for n up to EXACT_MAX without ties, by the numbers of sign patterns for each sum,
    else the normal approximation with the tie term (sum of t**3 - t) taken off the variance.
    """
    n = n.cast("int")
    half = (n * (n + 1) / 2).cast("int")
    one = F.transform(F.sequence(F.lit(0), half), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), n), one, lambda w, k: F.transform(w, lambda v, i: v + F.when(i >= k, F.get(w, i - k)).otherwise(0.0)))
    low = F.floor(F.least(w_plus, half - w_plus)).cast("int")
    exact = F.least(F.lit(1.0), 2 * F.aggregate(F.slice(ways, 1, low + 1), F.lit(0.0), lambda a, v: a + v) / F.pow(F.lit(2.0), n))
    m = n.cast("double")
    var = m * (m + 1) * (2 * m + 1) / 24 - tie_term / 48
    about = F.when(var > 0, norm_sf2((w_plus - m * (m + 1) / 4) / F.sqrt(var)))
    return F.when(n.isNull() | (n < least), F.lit(None)).when((n <= EXACT_MAX) & ~F.coalesce(ties, F.lit(False)), exact).otherwise(about)
