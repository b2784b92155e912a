"""Random-intercept models y ~ x + (1 | subject) for many keys at once, by restricted likelihood.

For a ratio r of between to residual variance, a subject enters the likelihood only by its
number of rows and a few sums. So rows are reduced to subjects, subjects of equal size are
folded into one row, and every key is evaluated on one grid of ratios; the ratio with the
least criterion is the estimate (on a grid of 0.1 in its logarithm, beta moves by far less
than its standard error from one to the next). Without a subject, the same sums are the
whole's less the subject's own, so leaving out each in turn takes no further pass over rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relisense.functions import tails
from relisense.functions.keep import keep

RATIOS = (0.0, *(math.exp(-14 + i / 10) for i in range(231)))
ROWS_MIN, SUBJECTS_MIN = 30, 3
_SUMS = ("a00", "a01", "a11", "b0", "b1", "yy", "logs", "rows", "subjects", "xx", "xs")


def subject_moments(rows: DataFrame, keys: list[str], y: str, x: str, subject: str) -> DataFrame:
    """(keys, subject, n, sx, sy, sxx, sxy, syy) of values less their means over the key, which keeps their digits."""
    r = rows.select(*keys, F.col(subject).alias("subject"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    means = r.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    c = r.join(means, keys).select(*keys, "subject", (F.col("x") - F.col("_mx")).alias("x"), (F.col("y") - F.col("_my")).alias("y"))
    return keep(c.groupBy(*keys, "subject").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") ** 2).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") ** 2).alias("syy")))


def _at(ratio: Column) -> dict[str, Column]:
    """What subjects of one size, ``c`` of them with summed moments, add to the likelihood's sums at a ratio."""
    n, c = F.col("n"), F.col("c")
    w, rest = ratio / (1 + n * ratio), 1 / (1 + n * ratio)
    return {
        "a00": c * n * rest, "a01": F.col("sx") * rest, "a11": F.col("sxx") - w * F.col("sx_sx"), "b0": F.col("sy") * rest, "b1": F.col("sxy") - w * F.col("sx_sy"), "yy": F.col("syy") - w * F.col("sy_sy"),
        "logs": c * F.log1p(n * ratio), "rows": c * n, "subjects": c, "xx": F.col("sxx"), "xs": F.col("sx"),
    }


def _products(moments: DataFrame) -> DataFrame:
    return moments.withColumns({"c": F.lit(1.0), "sx_sx": F.col("sx") ** 2, "sx_sy": F.col("sx") * F.col("sy"), "sy_sy": F.col("sy") ** 2})


def _on_grid(table: DataFrame, keys: list[str], ratios: tuple[float, ...]) -> DataFrame:
    each = table.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    return each.select(*keys, "ratio", *[v.alias(k) for k, v in _at(F.col("ratio")).items()])


def _best(sums: DataFrame, keys: list[str], ratios: tuple[float, ...]) -> DataFrame:
    """(keys, n, subjects, ratio, beta, se): the fit with the least criterion, of equal ones the least ratio."""
    col = F.col
    det = col("a00") * col("a11") - col("a01") ** 2
    t = sums.where((col("rows") >= ROWS_MIN) & (col("subjects") >= SUBJECTS_MIN) & (col("xx") - col("xs") ** 2 / col("rows") > 1e-12)).withColumn("det", det).where("det > 0")
    beta0, beta1 = (col("a11") * col("b0") - col("a01") * col("b1")) / col("det"), (col("a00") * col("b1") - col("a01") * col("b0")) / col("det")
    var = F.greatest((col("yy") - beta0 * col("b0") - beta1 * col("b1")) / (col("rows") - 2), F.lit(1e-300))
    t = t.withColumn("beta", beta1).withColumn("var", var)
    criterion = F.round((col("rows") - 2) * F.log("var") + col("logs") + F.log("det"), 9)
    fit = F.struct(col("rows").cast("long").alias("n"), col("subjects").cast("long").alias("subjects"), "ratio", "beta", F.sqrt(col("var") * col("a00") / col("det")).alias("se"))
    return t.groupBy(*keys).agg(F.min_by(fit, F.struct(criterion, "ratio")).alias("_f")).select(*keys, "_f.*")


def mixed_models(rows: DataFrame, keys: list[str], y: str = "y", x: str = "x", subject: str = "subject", ratios: tuple[float, ...] = RATIOS, leave_out: bool = True) -> DataFrame:
    """(keys, n, subjects, beta, se, z, p, icc, converged[, loso_min, loso_max, loso_max_delta, sign_flip]).

    Rows with a missing value are left out. Keys with fewer than ROWS_MIN rows or
    SUBJECTS_MIN subjects, or with a constant x, have no row. converged: the ratio is not the
    largest of the grid. loso_*: beta without each subject in turn, of those fits that exist.
    """
    moments = _products(subject_moments(rows, keys, y, x, subject))
    sizes = moments.groupBy(*keys, "n").agg(*[F.sum(c).alias(c) for c in ("c", "sx", "sy", "sxx", "sxy", "syy", "sx_sx", "sx_sy", "sy_sy")])
    totals = keep(_on_grid(sizes, keys, ratios).groupBy(*keys, "ratio").agg(*[F.sum(c).alias(c) for c in _SUMS]))
    full = _best(totals, keys, ratios)
    z = F.col("beta") / F.col("se")
    out = full.withColumn("z", z).withColumn("p", tails.norm_sf2(F.col("z"))).withColumn("icc", F.col("ratio") / (1 + F.col("ratio"))).withColumn("converged", F.col("ratio") < max(ratios)).drop("ratio")
    if not leave_out:
        return out
    own = _on_grid(moments, [*keys, "subject"], ratios).withColumnsRenamed({c: f"_{c}" for c in _SUMS})
    rest = own.join(totals, [*keys, "ratio"]).select(*keys, "subject", "ratio", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in _SUMS])
    without = _best(rest, [*keys, "subject"], ratios).select(*keys, F.col("beta").alias("_b"))
    spread = without.join(full.select(*keys, "beta"), keys).groupBy(*keys).agg(F.min("_b").alias("loso_min"), F.max("_b").alias("loso_max"), F.max(F.abs(F.col("_b") - F.col("beta"))).alias("loso_max_delta"), F.max(F.col("_b") * F.col("beta") < 0).alias("sign_flip"))
    return out.join(spread, keys, "left")
