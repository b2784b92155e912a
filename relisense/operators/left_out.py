"""Rank correlations without each subject in turn, from the ranks of all rows.

Without a subject, the rank of any other row falls by the number of the subject's own values
below it, equal ones counting half. So values are ranked once; along the ordered distinct
values a count per subject is carried, which turns every row's rank into its ranks in all of
the reduced tables. Rows are neither copied per subject nor ranked again: a row has one short
array for x and one for y, and its products are summed up per subject in the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relisense.functions.columns import div
from relisense.functions.keep import keep

#: Subjects whose counts are carried together (4 bytes each on every row); more are taken in turns.
SUBJECTS_AT_ONCE = 128
#: Ranges into which the distinct values of a test are cut.
RANGES = 32


def _below(pairs: DataFrame, column: str, subjects: int, ranges: int) -> DataFrame:
    """(test, value, rank, twice): for each distinct value its average rank and, per subject, twice
    the number of the subject's values below it plus the number of those equal.

    pairs: (test, s, column) with s from 0 to subjects, where ``subjects`` stands for all others.
    A range of values is gone through in order by one task, which starts from what lies
    before the range; these starts are rows of the same stream, ahead of the values.
    """
    per = keep(pairs.groupBy("test", F.col(column).alias("value"), "s").agg(F.count(F.lit(1)).alias("n")))
    cuts = per.groupBy("test").agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    placed = keep(per.join(cuts, "test").select("test", F.size(F.filter("_cuts", lambda b: b < F.col("value"))).alias("part"), "value", "s", "n"))
    sizes = placed.groupBy("test", "part", "s").agg(F.sum("n").alias("n"))
    parts = sizes.select("test", "part").distinct().join(sizes.select("test", "s").distinct(), "test")  # at most ranges x subjects rows a test
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("test", "s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.join(sizes, ["test", "part", "s"], "left").select("test", "part", F.lit(None).cast("double").alias("value"), "s", F.coalesce(before, F.lit(0)).alias("n"))
    stream = placed.unionByName(starts).repartition("test", "part").sortWithinPartitions("test", "part", F.col("value").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, np.zeros(subjects + 1, dtype=np.int64)
        open_value, own = None, np.zeros(subjects + 1, dtype=np.int64)  # the value whose rows may go on in the next batch

        def out(tests: list, values: list, below: np.ndarray, mine: np.ndarray) -> pa.RecordBatch:
            twice = 2 * below + mine
            rank = below.sum(axis=1) + (mine.sum(axis=1) + 1) / 2
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tests) + 1) * subjects, pa.int32()), pa.array(twice[:, :subjects].ravel(), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(tests, pa.string()), pa.array(values, pa.float64()), pa.array(rank), lists], names=["test", "value", "rank", "twice"])

        for b in batches:
            test, part, value, s, n = (b.column(i).to_pylist() if i in (0, 2) else b.column(i).to_numpy() for i in range(5))
            tests, values, below, mine = [], [], [], []
            for i in range(b.num_rows):
                if at != (test[i], part[i]):
                    if open_value is not None:
                        tests.append(at[0]), values.append(open_value), below.append(counts.copy()), mine.append(own.copy())
                    at, open_value = (test[i], part[i]), None
                    counts[:], own[:] = 0, 0
                if value[i] is None:
                    counts[s[i]] += n[i]
                    continue
                if value[i] != open_value:
                    if open_value is not None:
                        tests.append(at[0]), values.append(open_value), below.append(counts.copy()), mine.append(own.copy())
                    counts += own
                    own[:] = 0
                    open_value = value[i]
                own[s[i]] += n[i]
            if tests:
                yield out(tests, values, np.array(below), np.array(mine))
        if open_value is not None:
            yield out([at[0]], [open_value], counts[None, :], own[None, :])

    return keep(stream.select("test", "part", "value", "s", "n").mapInArrow(run, "test string, value double, rank double, twice array<long>"))


def _sums(rows: DataFrame, subjects: int) -> DataFrame:
    """(test, s, n, u, v, uu, vv, uv): sums over the rows of the others, from (test, s, rank_x, twice_x, rank_y, twice_y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = lambda i: b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, subjects) / 2
            tests = b.column(0).dictionary_encode()
            codes, s = tests.indices.to_numpy(), b.column(1).to_numpy()
            u = b.column(2).to_numpy()[:, None] - wide(3)
            v = b.column(4).to_numpy()[:, None] - wide(5)
            others = s[:, None] != np.arange(subjects)[None, :]
            for k, name in enumerate(tests.dictionary.to_pylist()):
                on = codes == k
                o, a, c = others[on].astype(float), u[on], v[on]
                sums = [o.sum(axis=0), *((o * x).sum(axis=0) for x in (a, c, a * a, c * c, a * c))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * subjects, pa.string()), pa.array(range(subjects), pa.int32()), *map(pa.array, sums)], names=["test", "s", "n", "u", "v", "uu", "vv", "uv"])

    return rows.mapInArrow(run, "test string, s int, n double, u double, v double, uu double, vv double, uv double")


def loso_correlations(pairs: DataFrame, subject: str = "subject", least: int = 3, ranges: int = RANGES) -> DataFrame:
    """(test, excluded, n, r): Spearman of (subject, test, x, y) without each subject of a test in turn.

    Left out are reduced tables of fewer than ``least`` rows; a constant side gives NULL.
    """
    spark = pairs.sparkSession
    rows = keep(pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(subject).isNotNull()).select("test", F.col(subject).alias("subject"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    found = sorted(r[0] for r in rows.select("subject").distinct().collect())  # a number per subject
    out = None
    for first in range(0, len(found), SUBJECTS_AT_ONCE):
        some = found[first : first + SUBJECTS_AT_ONCE]
        k = len(some)
        place = F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(some)], f"subject {dict(rows.dtypes)['subject']}, s int"))
        numbered = keep(rows.join(place, "subject", "left").select("test", F.coalesce("s", F.lit(k)).alias("s"), "x", "y"))
        for c in ("x", "y"):
            below = _below(numbered, c, k, ranges).withColumnsRenamed({"value": c, "rank": f"rank_{c}", "twice": f"twice_{c}"})
            numbered_rows = (numbered if c == "x" else numbered_rows).join(below, ["test", c])
        t = _sums(numbered_rows.select("test", "s", "rank_x", "twice_x", "rank_y", "twice_y"), k).groupBy("test", "s").agg(*[F.sum(c).alias(c) for c in ("n", "u", "v", "uu", "vv", "uv")])
        own = numbered.where(F.col("s") < k).select("test", "s").distinct()
        spread = lambda a, b, ab: F.col("n") * F.col(ab) - F.col(a) * F.col(b)
        r = div(spread("u", "v", "uv"), F.sqrt(F.greatest(spread("u", "u", "uu"), F.lit(0.0))) * F.sqrt(F.greatest(spread("v", "v", "vv"), F.lit(0.0))))
        part = t.join(own, ["test", "s"], "left_semi").where(F.col("n") >= least).withColumn("r", r).join(place, "s").select("test", F.col("subject").alias("excluded"), F.col("n").cast("long").alias("n"), "r")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.select("test", F.col("subject").alias("excluded"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("r")).limit(0)
