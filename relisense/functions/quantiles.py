"""Exact quantiles whose cost in one task is bounded.

``percentile`` keeps every distinct value in one task. That is fine up to EXACT_ROWS rows;
beyond, the wanted order statistics are first bracketed by ``percentile_approx`` (a sketch
of bounded size) and only the values inside the bracket are looked at exactly, again and
again until a bracket is small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relisense.functions.columns import as_col
from relisense.functions.keep import keep
from relisense.functions.ordered import joined, ranges_for, running_sums

EXACT_ROWS = 2_000_000
SKETCH_ACCURACY = 5_000
#: Distinct values up to which a column of a large table is counted by value.
FEW_VALUES = 100_000


def quantiles(df: DataFrame, wanted: dict[str, tuple], exact_rows: int = EXACT_ROWS, rows: int | None = None, weight: str | None = None) -> dict[str, float | None]:
    """wanted: name -> (column, fraction); linear interpolation between order statistics.

    All quantiles are read in one job if the table is small enough. NULL values are left
    out; a column without values gives None. rows: how many df has, where that is known.
    weight: column with the number of times that a row counts, for tables of ``by_value``.
    """
    if not wanted:
        return {}
    names = list(wanted)
    if weight is not None:
        row = df.agg(*[F.percentile(as_col(c).cast("double"), F.lit(float(q)), F.col(weight)).alias(f"q{i}") for i, (c, q) in enumerate(wanted.values())]).first()
        return dict(zip(names, row, strict=True))
    if (df.count() if rows is None else rows) <= exact_rows:
        row = df.agg(*[F.percentile(as_col(c).cast("double"), F.lit(float(q))).alias(f"q{i}") for i, (c, q) in enumerate(wanted.values())]).first()
        return dict(zip(names, row, strict=True))
    values = df.select(*[as_col(c).cast("double").alias(f"x{i}") for i, (c, _) in enumerate(wanted.values())])
    return dict(zip(names, _by_brackets(values, [q for _, q in wanted.values()], exact_rows), strict=True))


def by_value(df: DataFrame, columns: dict[str, Column], rows: int) -> list[tuple[DataFrame, dict[str, Column], str | None]]:
    """[(table, name -> column, weight)]: where quantiles of functions of one column each are best read.

    Columns with few distinct values are counted by value in one pass over a large table, and
    all that follows reads these counts; other columns stay with the table.
    """
    if rows <= EXACT_ROWS or not columns:
        return [(df, columns, None)]
    distinct = df.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns.values())]).first()
    few = [k for k, d in zip(columns, distinct, strict=True) if d <= FEW_VALUES]
    many = {k: c for k, c in columns.items() if k not in few}
    tables = [(df, many, None)] if many else []
    if few:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), columns[k].cast("double").alias("value")) for i, k in enumerate(few)]))
        counts = keep(df.select(each.alias("_c")).select("_c.*").where("value is not null").groupBy("of", "value").agg(F.count(F.lit(1)).alias("times")))
        tables.append((counts, {k: F.when(F.col("of") == i, F.col("value")) for i, k in enumerate(few)}, "times"))
    return tables


def median(df: DataFrame, column) -> float | None:
    return quantiles(df, {"m": (column, 0.5)})["m"]


def _by_brackets(x: DataFrame, fractions: list[float], exact_rows: int) -> list[float | None]:
    """The quantile of each column x0, x1, ...; a round of brackets reads the table twice for all columns together."""
    sizes = x.agg(*[F.count(c) for c in x.columns]).first()
    places = [q * (n - 1) for q, n in zip(fractions, sizes, strict=True)]
    inside = [F.col(c) for c in x.columns]  # the values within a column's bracket, else NULL
    before, left = [0] * len(sizes), list(sizes)  # values below the bracket, and within it
    wide = [i for i, n in enumerate(left) if n > exact_rows]
    while wide:
        step = 2 / SKETCH_ACCURACY
        ends = lambda i: [max(0.0, (math.floor(places[i]) - before[i] - 1) / left[i] - step), min(1.0, (math.ceil(places[i]) - before[i] + 2) / left[i] + step)]
        bounds = x.agg(*[F.percentile_approx(inside[i], ends(i), SKETCH_ACCURACY) for i in wide]).first()
        found = x.agg(*[f for i, (low, high) in zip(wide, bounds, strict=True) for f in (F.count_if(inside[i] < low), F.count_if(inside[i].between(low, high)))]).first()
        narrower = []
        for k, (i, (low, high)) in enumerate(zip(wide, bounds, strict=True)):
            below, within = found[2 * k], found[2 * k + 1]
            if not below <= math.floor(places[i]) - before[i] <= math.ceil(places[i]) - before[i] < below + within:
                raise RuntimeError("quantile sketch missed the place asked for")
            if exact_rows < within < left[i] and low < high:  # else few distinct values: percentile is cheap
                narrower.append(i)
            before[i], left[i], inside[i] = before[i] + below, within, F.when(inside[i].between(low, high), inside[i])
        wide = narrower
    at = [F.percentile(c, F.lit(min(1.0, (p - b) / max(1, n - 1)))) if n else F.lit(None).cast("double") for c, p, b, n in zip(inside, places, before, left, strict=True)]
    return list(x.agg(*[a.alias(f"q{i}") for i, a in enumerate(at)]).first())


def keyed_quantiles(df: DataFrame, keys: list[str], column: str, wanted: dict[str, float], exact_rows: int = EXACT_ROWS) -> DataFrame:
    """(keys, a column per wanted fraction): quantiles within each key, interpolated linearly.

    Keys without a value have no row. ``percentile`` is used where the largest key has so few
    rows that a task holds them; beyond, the distinct values of all keys are counted, cut into
    ranges and numbered by running sums, and of each key only the values at the wanted places
    are looked at.
    """
    rows = df.select(*keys, F.col(column).cast("double").alias("_value")).where("_value is not null")
    largest = rows.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    if (largest[0] or 0) <= exact_rows:
        return rows.groupBy(*keys).agg(*[F.percentile("_value", F.lit(float(q))).alias(k) for k, q in wanted.items()])
    counts = rows.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sums(counts, keys, "_value", ["_n"], ranges_for(largest[1]))
    whole = placed.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    both = joined(placed, whole, keys)
    at = lambda place: F.max(F.when((F.col("_n_before") <= place) & (place < F.col("_n_before") + F.col("_n")), F.col("_value")))
    ends = {}
    for k, q in wanted.items():
        place = F.lit(float(q)) * (F.col("_all") - 1)
        ends |= {f"_low_{k}": at(F.floor(place)), f"_high_{k}": at(F.ceil(place)), f"_part_{k}": F.max(place - F.floor(place))}
    found = both.groupBy(*keys).agg(*[v.alias(k) for k, v in ends.items()])
    return found.select(*keys, *[(F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * F.col(f"_part_{k}")).alias(k) for k in wanted])
