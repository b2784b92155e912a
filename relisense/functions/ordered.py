"""Frames over ordered rows of a key, without holding a whole key in one task.

A key's rows are cut into chunks of consecutive positions; each chunk also gets the few
neighbours that its frames reach into, so an ordinary window over (key, chunk) is exact.
Sums and last values from the key's beginning are carried over ranges of the order: a range
has one row of totals, those of the ranges before it are where its own frame starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relisense.functions.keep import keep

CHUNK = 50_000
#: Ranges into which a key's ordered values are cut, at least, and rows that a range is meant for.
RANGES, RANGE_ROWS = 32, 500_000
#: Rows of a whole table that one task may go through in order.
ONE_WINDOW = 500_000


def ranges_for(rows: int) -> int:
    return max(RANGES, -(-rows // RANGE_ROWS))


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a and b joined on keys, in which a missing key equals a missing key."""
    right = b.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_right_{k}`")) for k in keys]
    return a.join(right, on, how).drop(*[f"_right_{k}" for k in keys])


def in_ranges(df: DataFrame, keys: list[str], order: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``_range``: which of about equally full ranges of its key's ``order`` a row is in. Kept."""
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda b: b < F.col(order)))
    return keep(joined(df, cuts, keys).withColumn("_range", place).drop("_cuts"))


def running_sums(df: DataFrame, keys: list[str], order: str, columns: list[str], ranges: int = RANGES) -> DataFrame:
    """Adds ``{c}_before``: the sum of each column over the key's rows of lower ``order``; a row per key and order, none missing.

    A table of up to ONE_WINDOW rows in all takes one window; a larger one is cut into ranges.
    """
    df = keep(df)
    if df.count() <= ONE_WINDOW:
        below = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(below), F.lit(0)) for c in columns})
    placed = in_ranges(df, keys, order, ranges)
    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}_total") for c in columns])
    up = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_{c}_total").over(up), F.lit(0)).alias(f"_{c}_start") for c in columns])
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({f"_{c}_own": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    return joined(own, starts, [*keys, "_range"]).select(*df.columns, *[(F.col(f"_{c}_start") + F.col(f"_{c}_own")).alias(f"{c}_before") for c in columns])


def with_position(df: DataFrame, keys: list[str], order: str, name: str = "_pos", width: float | None = None) -> DataFrame:
    """Adds the place (from 0) of each row within its key by ``order``, an integral column.

    Rows are numbered inside ranges of ``order`` of the given width (CHUNK if None) and the
    ranges' sizes are summed up per key. Rows of equal order are numbered arbitrarily.
    """
    width = width or CHUNK
    part = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)).cast("long"))
    sizes = part.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_start", before).drop("_size")
    inner = part.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1)
    on = [inner[k].eqNullSafe(starts[k]) for k in [*keys, "_range"]]
    joined = inner.join(starts, on, "left").select(*[inner[c] for c in df.columns], (starts["_start"] + inner["_nth"]).alias(name))
    return joined


def rolling(df: DataFrame, keys: list[str], order: str, before: int, after: int, made: Callable[[object], dict[str, Column]]) -> DataFrame:
    """Adds columns made over frames that reach ``before`` rows back and ``after`` rows ahead.

    ``made`` gets the ordered window (without frame) and returns the new columns.
    """
    placed = with_position(df, keys, order).withColumn("_chunk", F.floor(F.col("_pos") / F.lit(CHUNK)).cast("long"))
    rest = F.col("_pos") % CHUNK
    copies = F.array_compact(F.array(F.when((rest >= CHUNK - before) & F.lit(before > 0), F.col("_chunk") + 1), F.col("_chunk"), F.when((rest < after) & (F.col("_chunk") > 0), F.col("_chunk") - 1)))
    spread = placed.withColumn("_in", F.explode(copies))
    w = Window.partitionBy(*keys, "_in").orderBy("_pos")
    return spread.withColumns(made(w)).where("_in = _chunk").drop("_in", "_chunk", "_pos")
