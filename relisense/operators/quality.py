"""Data quality: cell parsing, eligibility, exclusion reasons, coverage, diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relisense.functions.columns import as_col

#: A subject is flagged below or above these.
COMPLETENESS_MIN, ZEROS_MAX, OUTLIERS_MAX, DURATION_RATIO_MIN = 0.90, 0.20, 0.10, 0.50
EXTERNAL_MIN = 3


def parse_fraction(c: Column | str) -> Column:
    """``0.998``, ``4007 (0.994)``; ``n/a``, ``na``, empty and anything else are NULL."""
    text = F.lower(F.trim(as_col(c).cast("string")))
    number = text.try_cast("double")
    inside = F.regexp_extract(text, r"\(([-\d.]+)\)", 1).try_cast("double")
    value = F.coalesce(number, inside)
    return F.when(~F.isnan(value), value)


def eligible(availability: DataFrame, required: list[str], external: list[str], least: int = EXTERNAL_MIN) -> DataFrame:
    """Subjects with every required flag and enough external raters; missing flags count as false."""
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    every = reduce(lambda a, b: a & b, [yes(c) for c in required])
    many = reduce(lambda a, b: a + b, [yes(c).cast("int") for c in external])
    return availability.where(every & (many >= least))


def low_quality(table: DataFrame, modalities: list[str], subject: str = "subject") -> DataFrame:
    """(subject, reason) from columns ``{kind}_{modality}``; missing figures never flag.

    Reasons: completeness, zeros, outliers by any modality; durations by the ratio of the
    shortest to the longest.
    """
    over = lambda kind, test: reduce(lambda a, b: a | b, [F.coalesce(test(F.col(f"{kind}_{m}")), F.lit(False)) for m in modalities])
    durations = [F.col(f"durations_{m}") for m in modalities]
    shortest, longest = (F.least(*durations), F.greatest(*durations)) if len(durations) > 1 else (durations[0], durations[0])
    reasons = {
        "completeness": over("completeness", lambda c: c < COMPLETENESS_MIN), "zeros": over("zeros", lambda c: c > ZEROS_MAX), "outliers": over("outliers", lambda c: c > OUTLIERS_MAX),
        "durations": F.coalesce(F.try_divide(shortest, longest) < DURATION_RATIO_MIN, F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()]))
    return table.select(subject, F.explode(found).alias("reason"))


def filter_features(features: DataFrame, excluded: DataFrame, columns: list[str] | None = None, subject: str = "subject") -> DataFrame:
    """Without the excluded subjects, then without rows whose listed columns (default: all
    that end in ``_mean``) are all missing."""
    kept = features.join(excluded.select(subject).distinct(), subject, "left_anti")
    return kept.dropna(how="all", subset=columns or [c for c in features.columns if c.endswith("_mean")])


def common_keys(a: DataFrame, b: DataFrame, key: str = "item") -> tuple[DataFrame, DataFrame]:
    """Both tables on the keys they share; both whole if they share none."""
    shared = a.select(key).intersect(b.select(key))
    if shared.isEmpty():
        return a, b
    return a.join(shared, key, "left_semi"), b.join(shared, key, "left_semi")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def null_channels(df: DataFrame, core: list[str], aux: list[str]) -> DataFrame:
    """One row: rows, rows without any core value, and of those how many have each auxiliary value."""
    none = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in core])
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(none).alias("all_null"), *[F.count_if(none & F.col(c).isNotNull()).alias(f"{c}_present") for c in aux])


def coverage(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Share of rows with a value, per column (a row per key)."""
    return df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])


def out_of_range(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(column, outside): whether any value lies outside [low, high]."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(~F.col(c).between(low, high), F.lit(False)).alias("o")) for c in columns])
    return df.select(F.explode(each).alias("_e")).select("_e.*").groupBy("column").agg(F.bool_or("o").alias("outside"))


def describe(df: DataFrame, columns: list[str], fractions: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(column, n, mean, std, min, max, zero_share, q<percent>): a row per column, one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    rows = df.select(F.explode(each).alias("_e")).select("_e.*").where("v is not null")
    v = F.col("v")
    return rows.groupBy("column").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg((v == 0).cast("double")).alias("zero_share"), *[F.percentile("v", F.lit(q)).alias(f"q{round(q * 100)}") for q in fractions])


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "", infix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and infix in c]


def aligned(scores: list[DataFrame], key: str) -> DataFrame:
    """The tables joined by key: only records that every table has, with no value missing."""
    out = scores[0]
    for t in scores[1:]:
        out = out.join(t, key)
    return out.dropna()
