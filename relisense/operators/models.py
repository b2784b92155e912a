"""Linear models and paired tests from sufficient statistics.

Spark reduces the rows to a few sums per subject or per test; what is left to solve has
the size of the number of predictors or subjects.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relisense.functions import special, tails
from relisense.functions.quantiles import keyed_quantiles
from relisense.functions.keep import keep
from relisense.operators import mixed
from relisense.operators.ranks import average_rank


def ols(rows: DataFrame, target: str, predictors: list[str], standardise: bool = True) -> pd.DataFrame:
    """(term, beta, se, t, p, n): least squares with intercept; standardised by population deviations.

    A row per predictor. One pass for the moments, one for the products of centred values.
    """
    names = [target, *predictors]
    rows = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    stats = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in names], *[F.stddev_pop(c) for c in names]).first()
    n, mean, std = stats[0], stats[1 : 1 + len(names)], stats[1 + len(names) :]
    if n <= len(names) or any(not s for s in std):
        return pd.DataFrame(columns=["term", "beta", "se", "t", "p", "n"])
    z = [(F.col(c) - m) / (s if standardise else 1.0) for c, m, s in zip(names, mean, std, strict=True)]
    g = np.array(rows.agg(*[F.sum(a * b) for a in z for b in z]).first()).reshape(len(names), len(names))
    inv = np.linalg.inv(g[1:, 1:])
    beta = inv @ g[1:, 0]
    df = n - len(predictors) - 1
    se = np.sqrt(np.diag(inv) * (g[0, 0] - beta @ g[1:, 0]) / df)
    return pd.DataFrame({"term": predictors, "beta": beta, "se": se, "t": beta / se, "p": [special.t_sf2(b / s, df) for b, s in zip(beta, se, strict=True)], "n": n})


def subject_sums(rows: DataFrame, y: str, x: str, subject: str = "subject") -> DataFrame:
    """(subject, n, sx, sy, sxx, sxy, syy): all that a random-intercept fit needs."""
    r = rows.select(subject, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return r.groupBy(subject).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") ** 2).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") ** 2).alias("syy"))


def _reml(s: pd.DataFrame, ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """(criterion, beta, inverse of X'V^-1 X, sigma^2) at a ratio of between to residual variance."""
    n = s["n"].to_numpy()
    w = ratio / (1 + n * ratio)  # V^-1 = I - w * ones, per subject
    sx, sy = s["sx"].to_numpy(), s["sy"].to_numpy()
    a = np.array([[(n - w * n * n).sum(), (sx - w * n * sx).sum()], [0, (s["sxx"].to_numpy() - w * sx * sx).sum()]])
    a[1, 0] = a[0, 1]
    b = np.array([(sy - w * n * sy).sum(), (s["sxy"].to_numpy() - w * sx * sy).sum()])
    yy = (s["syy"].to_numpy() - w * sy * sy).sum()
    inv = np.linalg.inv(a)
    beta = inv @ b
    df = n.sum() - 2
    var = max((yy - beta @ b) / df, 1e-300)
    return df * math.log(var) + np.log1p(n * ratio).sum() + math.log(np.linalg.det(a)), beta, inv, var


def mixed_model(sums: pd.DataFrame, least_rows: int = 30, least_subjects: int = 3) -> dict:
    """One random-intercept model y ~ x by restricted likelihood, to full precision: beta, se, z, p, icc, converged.

    For many keys, and without each subject, see ``mixed``, which stays in Spark. sums: a row per subject (subject_sums). The one variance ratio is found on a grid and
    refined by golden section; too few rows or subjects, or a constant x, give NaN.
    """
    nan = dict.fromkeys(("beta", "se", "z", "p", "icc"), math.nan) | {"converged": False}
    if len(sums) < least_subjects or sums["n"].sum() < least_rows or sums["sxx"].sum() - sums["sx"].sum() ** 2 / sums["n"].sum() <= 1e-12:
        return nan
    # values near zero keep the digits of the products
    shift = sums["sy"].sum() / sums["n"].sum()
    s = sums.assign(syy=sums["syy"] - 2 * shift * sums["sy"] + sums["n"] * shift**2, sxy=sums["sxy"] - shift * sums["sx"], sy=sums["sy"] - shift * sums["n"])
    grid = [0.0, *np.exp(np.linspace(-14, 9, 70))]
    best = min(range(len(grid)), key=lambda i: _reml(s, grid[i])[0])
    low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    g = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        p, q = high - g * (high - low), low + g * (high - low)
        if _reml(s, p)[0] < _reml(s, q)[0]:
            high = q
        else:
            low = p
    ratio = min((low, (low + high) / 2, grid[best]), key=lambda r: _reml(s, r)[0])
    _, beta, inv, var = _reml(s, ratio)
    se = math.sqrt(var * inv[1, 1])
    z = beta[1] / se
    return {"beta": float(beta[1]), "se": se, "z": float(z), "p": 2 * special.norm_sf(abs(z)), "icc": ratio / (1 + ratio), "converged": best < len(grid) - 1}


def period_means(df: DataFrame, column: str, subject: str = "subject") -> DataFrame:
    """(subject, pre, debate)."""
    return df.groupBy(subject).pivot("period", ["pre", "debate"]).agg(F.avg(column))


def signed_rank(pairs: DataFrame, keys: list[str], d: str) -> DataFrame:
    """(keys, n, w_plus, positive, negative, median_diff, mean_diff, ties, tie_term) over differences;
    n counts those that are not zero."""
    rows = pairs.where(F.col(d).isNotNull())
    moved = rows.where(F.col(d) != 0).withColumn("_abs", F.abs(d))
    ranked = average_rank(moved, keys, "_abs", "_r")
    per = ranked.groupBy(*keys, "_abs").agg(F.count(F.lit(1)).cast("double").alias("t"), F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("w"))
    w = per.groupBy(*keys).agg(F.sum("t").cast("long").alias("n"), F.sum("w").alias("w_plus"), (F.max("t") > 1).alias("ties"), F.sum(F.col("t") ** 3 - F.col("t")).alias("tie_term"))
    more = rows.groupBy(*keys).agg(F.count_if(F.col(d) > 0).alias("positive"), F.count_if(F.col(d) < 0).alias("negative"), F.avg(d).alias("mean_diff"))
    return more.join(keyed_quantiles(rows, keys, d, {"median_diff": 0.5}), keys, "left").join(w, keys, "left").fillna(0, ["n"]).fillna(0.0, ["w_plus", "tie_term"])


def with_wilcoxon_p(table: DataFrame) -> DataFrame:
    """Adds ``p``, two-sided, to a table of signed-rank statistics; NULL for fewer than three differences."""
    return table.withColumn("p", tails.wilcoxon_p(F.col("n"), F.col("w_plus"), F.col("tie_term"), F.col("ties")))


def with_t_p(table: DataFrame, t: str, df: Column) -> DataFrame:
    """Adds ``p``, two-sided, to a table of t statistics."""
    return table.withColumn("p", tails.t_sf2(F.col(t), df))


def paired_t(pairs: DataFrame, keys: list[str], d: str) -> DataFrame:
    """(keys, n, t)."""
    t = F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d)))
    return pairs.groupBy(*keys).agg(F.count(d).alias("n"), t.alias("t"))


def task_validity(df: DataFrame, columns: list[str], drops: tuple[int, ...] = (1, 2), subject: str = "subject") -> DataFrame:
    """A row per column: mixed-model contrast of debate against pre, its leave-one-out range, the
    signed-rank test on subject means, coverage by period, and betas without the first windows.

    All columns, with and without the first windows, are keys of one long table.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("y")) for c in columns]))
    long = keep(df.select(F.col(subject).alias("subject"), "period", "win_in_period", (F.col("period") == "debate").cast("int").alias("x"), each.alias("_c")).select("subject", "period", "win_in_period", "x", "_c.*"))
    out = mixed.mixed_models(long, ["column"])
    later = long.withColumn("without", F.explode(F.array(*[F.lit(k) for k in drops]))).where(F.col("win_in_period") >= F.col("without"))
    betas = mixed.mixed_models(later, ["column", "without"], leave_out=False)
    betas = betas.groupBy("column").agg(*[F.max(F.when(F.col("without") == k, F.col("beta"))).alias(f"beta_drop{k}") for k in drops])
    mean = lambda p: F.avg(F.when(F.col("period") == p, F.col("y")))
    d = long.groupBy("column", "subject").agg((mean("debate") - mean("pre")).alias("d"))
    ranked = with_wilcoxon_p(signed_rank(d, ["column"], "d")).select("column", *[F.col(c).alias(f"wilcoxon_{c}") for c in ("n", "w_plus", "p", "positive", "negative", "median_diff", "mean_diff")])
    covered = lambda p: F.avg(F.when(F.col("period") == p, F.col("y").isNotNull().cast("double"))).alias(f"coverage_{p}")
    coverage = long.groupBy("column").agg(covered("pre"), covered("debate"))
    return coverage.join(out, "column", "left").join(ranked, "column", "left").join(betas, "column", "left")
