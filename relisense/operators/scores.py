"""Reliability scores. Every population score is fitted on one table and applied to any other.

Fitting reads a few quantiles or moments (one row each) to the driver; applying is a plain
column expression with those numbers in it, so no join is planned for it. Whether a filter
comes before or after the fit changes the scores and is left to the caller.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relisense.functions.columns import as_col, div
from relisense.functions.quantiles import by_value, quantiles

#: Offset under the logarithm, share below which a signal counts as flat, the
#: threshold where no positive value exists, the factor from MAD to sigma, and the scale of
#: coherence and monotone scores.
EPS, FLAT_SHARE, FLAT_FALLBACK, MAD_SCALE, SCALE = 1e-9, 0.01, 1e-6, 1.4826, 2.0


def _log(c: Column) -> Column:
    return F.when(c + EPS > 0, F.log(c + EPS))


@dataclass(frozen=True)
class UScore:
    """exp(-z*z/2) of the robust z of ln(sigma); 0 below the flat threshold."""

    eps: float
    med: float
    mad: float

    def z(self, c: Column | str) -> Column:
        return (_log(as_col(c)) - self.med) / self.mad

    def score(self, c: Column | str, null_policy: str = "null", shape: str = "gauss") -> Column:
        """shape "gauss", or "mono": 1/(1+|z|). null_policy "null", or "one": missing counts as 1."""
        c = as_col(c)
        z = self.z(c)
        value = F.exp(-0.5 * z * z) if shape == "gauss" else 1 / (1 + F.abs(z))
        out = F.when(c < self.eps, 0.0).when(c.isNotNull(), value)
        return out.otherwise(1.0) if null_policy == "one" else out

    @staticmethod
    def fit(df: DataFrame, columns: dict[str, Column | str] | list[str], cut: bool = True) -> dict[str, UScore]:
        """One model per column, from three reads of the table, or of its values' counts, for all columns together.

        cut=False leaves out the flat threshold. A column whose values are all below it, or
        missing, gets centre 0 and scale 1.
        """
        named = {k: as_col(v) for k, v in (columns if isinstance(columns, dict) else {c: c for c in columns}).items()}
        rows, models = df.count(), {}
        for table, cols, weight in by_value(df, named, rows):
            read = lambda wanted, t=table, w=weight: quantiles(t, wanted, rows=rows, weight=w)
            low = read({k: (F.when(c > 0, c), FLAT_SHARE) for k, c in cols.items()}) if cut else dict.fromkeys(cols, -math.inf)
            eps = {k: FLAT_FALLBACK if v is None else v for k, v in low.items()}
            logs = {k: F.when(c >= eps[k], _log(c)) if cut else _log(c) for k, c in cols.items()}
            med = {k: 0.0 if v is None else v for k, v in read({k: (x, 0.5) for k, x in logs.items()}).items()}
            mad = read({k: (F.abs(x - med[k]), 0.5) for k, x in logs.items()})
            models |= {k: UScore(eps[k], med[k], MAD_SCALE * mad[k] if mad[k] else 1.0) for k in cols}
        return {k: models[k] for k in named}


@dataclass(frozen=True)
class ClassicZ:
    """exp(-z*z/2) with mean and population deviation of ln(sigma)."""

    eps: float
    mean: float
    std: float

    def score(self, c: Column | str) -> Column:
        c = as_col(c)
        z = (_log(c) - self.mean) / self.std
        return F.when(c < self.eps, 0.0).when(c.isNotNull(), F.exp(-0.5 * z * z))

    @staticmethod
    def fit(df: DataFrame, column: Column | str) -> ClassicZ:
        c = as_col(column)
        low = quantiles(df, {"e": (F.when(c > 0, c), FLAT_SHARE)})["e"]
        eps = FLAT_FALLBACK if low is None else low
        mean, std = df.agg(F.avg(F.when(c >= eps, _log(c))), F.stddev_pop(F.when(c >= eps, _log(c)))).first()
        return ClassicZ(eps, mean or 0.0, std or 1.0)


@dataclass(frozen=True)
class MinMax:
    low: float | None
    high: float | None

    def score(self, c: Column | str) -> Column:
        c = as_col(c)
        if self.low is None or self.high <= self.low:
            return F.when(c.isNotNull(), 0.5)
        return (c - self.low) / (self.high - self.low)

    @staticmethod
    def fit(df: DataFrame, column: Column | str) -> MinMax:
        return MinMax(*df.agg(F.min(as_col(column)), F.max(as_col(column))).first())


@dataclass(frozen=True)
class Monotone:
    """1 - exp(-max(z, 0)/2) of the robust z in one direction."""

    med: float
    mad: float
    direction: int

    def score(self, c: Column | str) -> Column:
        c = as_col(c)
        z = self.direction * (c - self.med) / (MAD_SCALE * self.mad)
        return F.when(c.isNotNull(), 1 - F.exp(-F.greatest(z, F.lit(0.0)) / SCALE))

    @staticmethod
    def fit(df: DataFrame, columns: dict[str, tuple[Column | str, int]]) -> dict[str, Monotone]:
        """columns: name -> (column, +1 or -1). Without spread by MAD the population deviation stands in, then 1."""
        named = {k: as_col(c) for k, (c, _) in columns.items()}
        rows, med, mad = df.count(), {}, {}
        for table, cols, weight in by_value(df, named, rows):
            med |= {k: 0.0 if v is None else v for k, v in quantiles(table, {k: (c, 0.5) for k, c in cols.items()}, rows=rows, weight=weight).items()}
            mad |= quantiles(table, {k: (F.abs(c - med[k]), 0.5) for k, c in cols.items()}, rows=rows, weight=weight)
        flat = [k for k in named if not mad[k]]
        std = dict(zip(flat, df.agg(*[F.stddev_pop(named[k]).alias(f"s{i}") for i, k in enumerate(flat)]).first(), strict=True)) if flat else {}
        return {k: Monotone(med[k], mad[k] or std[k] or 1.0, columns[k][1]) for k in named}


def composite(legs: list[Column | str], weights: list[float]) -> Column:
    """Weighted sum; ValueError unless there is a weight per leg and they add up to 1."""
    if len(legs) != len(weights) or not math.isclose(sum(weights), 1.0, abs_tol=1e-6):
        raise ValueError(f"weights {weights} for {len(legs)} legs must add up to 1")
    total = None
    for leg, w in zip(legs, weights, strict=True):
        total = as_col(leg) * w if total is None else total + as_col(leg) * w
    return total


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``{c}_imputed``, with the population median for what is missing."""
    med = quantiles(df, {c: (c, 0.5) for c in columns})
    return df.withColumns({f"{c}_imputed": F.coalesce(F.col(c), F.lit(med[c])) for c in columns})


def composite_imputed(df: DataFrame, estab: str, coher: str, cond: str | None, weights=(1 / 3, 1 / 3, 1 / 3), name: str = "score") -> DataFrame:
    """Composite of median-imputed legs; without a third leg the other two count half each."""
    legs = [estab, coher] + ([cond] if cond else [])
    out = imputed(df, legs)
    return out.withColumn(name, composite([f"{c}_imputed" for c in legs], list(weights) if cond else [0.5, 0.5]))


def plausibility_gate(score: Column | str, cond: Column | str, threshold: float = 0.5) -> Column:
    """0 where the condition leg is below the threshold; missing conditions change nothing."""
    return F.when(as_col(cond) < threshold, 0.0).otherwise(as_col(score))


def z_baseline(value, base, std) -> Column:
    """(value - base) / std; NULL for no or zero deviation."""
    return div(as_col(value) - as_col(base), as_col(std))


def coherence(za, zb, scale: float = SCALE) -> Column:
    return F.exp(-F.abs(as_col(za) - as_col(zb)) / scale)


def snr_reliability(snr, reference: float = 10.0, slope: float = 0.5) -> Column:
    """Logistic map of a ratio in dB; minus infinity gives 0."""
    snr = as_col(snr)
    return F.when(snr == float("-inf"), 0.0).when(snr.isNotNull(), 1 / (1 + F.exp(-slope * (snr - reference))))


def plausible_share(samples, low: float, high: float, least: int = 1) -> Column:
    """Share of the non-missing samples of an array inside [low, high]; NULL for too few."""
    present = F.filter(samples, lambda x: x.isNotNull() & ~F.isnan(x))
    inside = F.filter(present, lambda x: x.between(low, high))
    return F.when(F.size(present) >= least, div(F.size(inside), F.size(present)))
