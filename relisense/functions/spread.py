"""Dealing rows to tasks by their keys, in parts that don't grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a part is meant for: a task's hash tables over them take a few pages of memory.
PART_ROWS = 200_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """The rows dealt by keys, into as many more parts as there are more rows.

    Adaptive execution joins small shuffle partitions until they hold 64 MB of compressed
    bytes, which may be millions of narrow rows; parts whose number is given are left alone.
    A grouping by these keys, or by more, needs no further shuffle. rows: how many df has,
    where that is known.
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS)), *keys)
