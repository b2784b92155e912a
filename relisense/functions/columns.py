"""Null-safe column arithmetic. Missing values are NULL everywhere; NaN is turned into NULL at the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(f"`{c}`")) for c in floats}) if floats else df


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(as_col(a), as_col(b))


def row_mean(cols: list[Column | str]) -> Column:
    """Mean over columns without the missing ones; NULL if all are missing or there are none."""
    if not cols:
        return F.lit(None).cast("double")
    cols = [as_col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return div(total, reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols]))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with minus zero as zero."""
    return F.round(as_col(c), digits) + F.lit(0.0)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: correlation over rows where both are present; NULL for a constant column."""
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return div(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def where_agg(agg, cond: Column, c: Column | str) -> Column:
    return agg(F.when(cond, as_col(c)))


def first_present(df: DataFrame, names: list[str]) -> str:
    """The first of these columns that the table has."""
    for n in names:
        if n in df.columns:
            return n
    raise KeyError(f"none of {names} in {df.columns}")


def unique_columns(df: DataFrame) -> DataFrame:
    """The table itself; ValueError if two columns share a name."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError(f"repeated columns: {sorted({c for c in df.columns if df.columns.count(c) > 1})}")
    return df
