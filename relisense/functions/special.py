"""Tails of the normal, t, chi-square and Wilcoxon distributions for tables of test results."""

from __future__ import annotations

import math
from functools import lru_cache


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def correlation_p(r: float | None, n: int, lost: int = 0) -> float | None:
    """Two-sided p of a correlation over n pairs, with ``lost`` degrees of freedom for controls."""
    df = n - 2 - lost
    if r is None or df < 1:
        return None
    if abs(r) >= 1:
        return 0.0
    return t_sf2(r * math.sqrt(df / (1 - r * r)), df)


@lru_cache(maxsize=128)
def _signed_rank_counts(n: int) -> tuple[int, ...]:
    ways = [1]
    for k in range(1, n + 1):
        new = ways + [0] * k
        for i, w in enumerate(ways):
            new[i + k] += w
        ways = new
    return tuple(ways)


def wilcoxon_p(n: int, w_plus: float, tie_term: float, ties: bool, exact_max: int = 50) -> float | None:
    """Two-sided p of the signed-rank statistic over n non-zero differences.

    Exact for n up to exact_max without ties, else the normal approximation with the tie
    term (sum of t**3 - t) taken off the variance.
    """
    if n < 1:
        return None
    if n <= exact_max and not ties:
        ways = _signed_rank_counts(n)
        w = int(min(w_plus, n * (n + 1) / 2 - w_plus))
        return min(1.0, 2 * sum(ways[: w + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    return 2 * norm_sf(abs(w_plus - n * (n + 1) / 4) / math.sqrt(var)) if var > 0 else None
