"""The numbers behind the studies' figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int = 50, keys: list[str] | None = None) -> DataFrame:
    """(keys, bin, low, high, n) over equal bins between the least and the largest value; the
    largest falls in the last bin, empty bins have no row."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.select(*(keys or []), F.lit(0).alias("bin"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("n")).limit(0)
    width = float(high - low) or 1.0
    place = F.least(F.floor((F.col(column) - low) / width * float(bins)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(*(keys or []), place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edge = lambda k: F.lit(float(low)) + width * k / float(bins)
    return counts.withColumn("low", edge(F.col("bin"))).withColumn("high", edge(F.col("bin") + 1))


def box_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, n, low, q1, median, q3, high)."""
    q = lambda f: F.percentile(column, F.lit(f))
    return df.where(F.col(column).isNotNull()).groupBy(group).agg(F.count(column).alias("n"), F.min(column).alias("low"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(column).alias("high"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, r): Pearson correlations of all pairs of columns, long."""
    from relisense.operators.ranks import correlations, long_pairs

    tests = {f"{a}|{b}": (a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]}
    t = correlations(long_pairs(df, tests), ["test"], "pearson", least=2)
    return t.select(F.split_part("test", F.lit("|"), F.lit(1)).alias("a"), F.split_part("test", F.lit("|"), F.lit(2)).alias("b"), "n", "r")
