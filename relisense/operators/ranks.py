"""Rank statistics, keyed by test: any number of tests runs as one job over a long table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relisense.functions import tails
from relisense.functions.columns import as_col, div, pearson
from relisense.functions.keep import keep
from relisense.functions.ordered import joined, running_sums, with_position
from relisense.functions.quantiles import keyed_quantiles
from relisense.operators.left_out import loso_correlations

#: Ranges into which the distinct values of a test are cut for ranking.
RANK_RANGES = 32


def value_ranks(df: DataFrame, keys: list[str], column: str, name: str, ranges: int = RANK_RANGES) -> DataFrame:
    """(keys, column, name): the rank of each distinct value of ``column`` within its key, ties averaged.

    Distinct values are counted first and cut into ranges of about equal size, so that a
    key of any size is ranked by many tasks.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    return keep(running_sums(counts, keys, column, ["_n"], ranges).select(*keys, column, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name)))


def average_rank(df: DataFrame, keys: list[str], column: str, name: str, ranges: int = RANK_RANGES) -> DataFrame:
    """Adds the rank of ``column`` within its key, ties averaged; missing values get none."""
    return df.join(value_ranks(df, keys, column, name, ranges), [*keys, column], "left")


def ranked_columns(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds ``_rank_{c}`` for each column: all of them are ranked in one long table, keyed by column."""
    df = keep(df)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]))
    ranks = value_ranks(df.select(*keys, each.alias("_c")).select(*keys, "_c.*"), [*keys, "_column"], "_value", "_rank")
    for c in columns:
        df = df.join(ranks.where(F.col("_column") == c).select(*keys, F.col("_value").alias(c), F.col("_rank").alias(f"_rank_{c}")), [*keys, c], "left")
    return df


def long_pairs(df: DataFrame, tests: dict[str, tuple[Column | str, Column | str]], keep: list[str] | None = None) -> DataFrame:
    """(keep, test, x, y): a row per row and test in which both values are present.

    One pass over the table: the tests are an array that is exploded.
    """
    each = F.array(*[F.struct(F.lit(k).alias("test"), as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y")) for k, (x, y) in tests.items()])
    rows = df.select(*(keep or []), F.explode(each).alias("_t")).select(*(keep or []), "_t.test", "_t.x", "_t.y")
    return rows.where("x is not null and y is not null")


def correlations(pairs: DataFrame, keys: list[str], method: str = "spearman", least: int = 10, digits: int | None = None) -> DataFrame:
    """(keys, n, r): per key; groups of fewer than ``least`` pairs are left out.

    digits: decimals to which values are rounded first, so that means of equal values tie
    although their sums were taken in another order.
    """
    if digits is not None:
        pairs = pairs.withColumn("x", F.round("x", digits)).withColumn("y", F.round("y", digits))
    if method == "spearman":
        pairs = ranked_columns(pairs.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), keys, ["x", "y"])
        r = pearson("_rank_x", "_rank_y")
    else:
        r = pearson("x", "y")
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r.alias("r")).where(F.col("n") >= least)


def with_p(tests: DataFrame, r: str = "r", n: str = "n", lost: int = 0) -> DataFrame:
    """Adds ``p``, two-sided, to a table of correlations (one row per test)."""
    return tests.withColumn("p", tails.correlation_p(r, n, lost))


def with_chi2_p(tests: DataFrame, statistic: str, df: str) -> DataFrame:
    return tests.withColumn("p", tails.chi2_sf(F.col(statistic), F.col(df)))


def kruskal(rows: DataFrame, keys: list[str], group: str, value: str, least_group: int = 2, least: int = 4) -> DataFrame:
    """(keys, n, k, h, eps2): H with tie correction; eps2 = (H-k+1)/(n-k).

    Groups smaller than ``least_group`` are left out first; keys with fewer than two groups
    or ``least`` values get no row.
    """
    rows = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    big = rows.groupBy(*keys, group).count().where(F.col("count") >= least_group).drop("count")
    ranked = average_rank(rows.join(big, [*keys, group]), keys, value, "_r")
    ties = ranked.groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    sums = ranked.groupBy(*keys, group).agg(F.sum("_r").alias("s"), F.count(F.lit(1)).alias("m")).groupBy(*keys).agg(F.sum(F.col("s") ** 2 / F.col("m")).alias("q"), F.count(F.lit(1)).alias("k"))
    n = F.col("n")
    out = ties.join(sums, keys).where((n >= least) & (F.col("k") >= 2))
    h = div(F.lit(12.0) / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("ties") / (n**3 - n))
    return out.withColumn("h", h).select(*keys, n.cast("long").alias("n"), "k", "h", div(F.col("h") - F.col("k") + 1, n - F.col("k")).alias("eps2"))


def group_medians(rows: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """(keys, group, n, median)."""
    by = [*keys, group]
    n, m = rows.groupBy(*by).agg(F.count(value).alias("n")), keyed_quantiles(rows, by, value, {"median": 0.5})
    return joined(n, m, by, "left")


def adjust(tests: DataFrame, pool: list[str] | None = None, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Adds Bonferroni and Benjamini-Hochberg values and decisions over each pool.

    Rows without p stay, without any of them, and don't count. ``pool``: key columns of a
    pool; none: all rows are one pool (a row per test, so one window holds them).
    """
    keys = pool or []
    has = tests.where(F.col(p).isNotNull())
    w = Window.partitionBy(*keys)
    m = F.count(F.lit(1)).over(w)
    up = Window.partitionBy(*keys).orderBy(F.col(p))
    out = has.withColumn("_m", m).withColumn("_k", F.row_number().over(up))
    down = Window.partitionBy(*keys).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("p_bonferroni", F.least(F.col(p) * F.col("_m"), F.lit(1.0)))
    out = out.withColumn("p_fdr", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_k")).over(down))).drop("_m", "_k")
    out = out.withColumn("reject_bonferroni", F.col("p_bonferroni") <= alpha).withColumn("reject_fdr", F.col("p_fdr") <= alpha)
    return out.unionByName(tests.where(F.col(p).isNull()), allowMissingColumns=True)


def partial_from_moments(rows: DataFrame, keys: list[str], x: str, y: str, controls: list[str]) -> DataFrame:
    """(keys, n, r): correlation of x and y with the controls held, from one pass of sums.

    The correlation matrix of a key has a row per variable, so it is inverted in a small
    function over the aggregated table; a singular matrix gives NULL.
    """
    names = [x, y, *controls]
    k = len(names)
    rows = rows.dropna(subset=names)
    # centred on the key's means, so that the sums of products keep their digits
    means = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in names])
    rows = rows.join(means, keys).select(*keys, *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in names])
    moments = F.array(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names])
    table = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), moments.alias("_s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            r = []
            for s in b.pop("_s"):
                c = np.array(s, dtype=float).reshape(k, k)
                d = np.sqrt(np.diag(c))
                ok = (d > 0).all()
                c = c / np.outer(d, d) if ok else c
                if not ok or np.linalg.matrix_rank(c, tol=1e-10) < k:
                    r.append(None)
                    continue
                v = np.linalg.inv(c)
                r.append(float(-v[0, 1] / np.sqrt(v[0, 0] * v[1, 1])))
            yield b.assign(r=pd.Series(r, dtype="float64", index=b.index))

    from pyspark.sql.types import DoubleType, StructField, StructType

    fields = [f for f in table.schema.fields if f.name != "_s"]
    return table.mapInPandas(run, StructType([*fields, StructField("r", DoubleType())]))


def partial_spearman(rows: DataFrame, keys: list[str], x: str, y: str, controls: list[str], least: int = 10, digits: int | None = None) -> DataFrame:
    """Ranks every variable within the key, then partial correlation of the ranks."""
    names = [x, y, *controls]
    rows = rows.dropna(subset=names)
    if digits is not None:
        rows = rows.withColumns({c: F.round(c, digits) for c in names})
    rows = ranked_columns(rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]), keys, names)
    ranked = rows.select(*keys, *[F.col(f"_rank_{c}").alias(c) for c in names])
    return partial_from_moments(ranked, keys, x, y, controls).where(F.col("n") >= least)


def leverage_of(df: DataFrame, tests: dict[str, tuple[Column | str, Column | str]], subject: str = "subject", least: int = 10, digits: int | None = None) -> DataFrame:
    """Per test: rho over all rows, between subjects' means, within (centred) and without each subject.

    Columns: test, n, rho_full, rho_between, rho_within, p_within, loso_min, loso_max,
    loso_max_delta, most_influential. All correlations of all tests run as three keyed jobs;
    those without a subject come from the ranks of all rows (see ``left_out``). digits: as in
    ``correlations``, for all of them.
    """
    pairs = keep(long_pairs(df, tests, [subject]))
    full = correlations(pairs, ["test"], least=least, digits=digits).select("test", "n", F.col("r").alias("rho_full"))
    means = keep(pairs.groupBy("test", subject).agg(F.avg("x").alias("mx"), F.avg("y").alias("my")))
    between = correlations(means.select("test", F.col("mx").alias("x"), F.col("my").alias("y")), ["test"], least=3, digits=digits).select("test", F.col("r").alias("rho_between"))
    inner = pairs.join(means, ["test", subject]).select("test", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    within = with_p(correlations(inner, ["test"], least=least, digits=digits)).select("test", F.col("r").alias("rho_within"), F.col("p").alias("p_within"))
    rows = pairs if digits is None else pairs.withColumns({c: F.round(c, digits) for c in ("x", "y")})
    left_out = loso_correlations(rows, subject).select("test", "excluded", "r").join(full, "test").withColumn("delta", F.abs(F.col("r") - F.col("rho_full")))
    influence = F.struct(F.round("delta", 9), "excluded")
    loso = left_out.groupBy("test").agg(F.min("r").alias("loso_min"), F.max("r").alias("loso_max"), F.max("delta").alias("loso_max_delta"), F.max_by("excluded", F.when(F.col("delta").isNotNull(), influence)).alias("most_influential"))
    return full.join(between, "test", "left").join(within, "test", "left").join(loso, "test", "left")


def leverage(df: DataFrame, x: str, targets: list[str], subject: str = "subject", least: int = 10) -> DataFrame:
    """``leverage_of`` one column against each target; the target's name stands in ``target``."""
    return leverage_of(df, {t: (x, t) for t in targets}, subject, least).withColumnRenamed("test", "target")


def cross_correlogram(df: DataFrame, x: str, y: str, lags: int = 6, common: int = 15, key: str = "subject", order: str = "win", least: int = 10) -> DataFrame:
    """(key, lag, n, r): Spearman of x and y at each lag from -lags to lags, by place among the
    rows that have both; keys with fewer than ``common`` such rows are left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, order, x, y)
    enough = rows.groupBy(key).count().where(F.col("count") >= common).select(key)
    placed = keep(with_position(rows.join(enough, key, "left_semi"), [key], order, "_p"))
    here = placed.select(key, F.col("_p").alias("_at"), F.col(x).alias("x"))
    there = placed.select(key, F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag"), F.col("_p"), F.col(y).alias("y")).withColumn("_at", F.col("_p") + F.col("lag"))
    return correlations(here.join(there, [key, "_at"]).select(key, "lag", "x", "y"), [key, "lag"], least=least)


def strongest_lag(correlogram: DataFrame, key: str = "subject") -> DataFrame:
    """(key, lag): where the correlation is largest in size; of equal ones the first lag."""
    size = F.struct(F.round(F.abs("r"), 9), -F.col("lag"))
    return correlogram.where("r is not null").groupBy(key).agg(F.max_by("lag", size).alias("lag"))
