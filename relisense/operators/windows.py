"""Tumbling windows over long signal tables, and the wide window table.

A long table has (subject, channel, t, value[, axis]); all subjects are handled at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relisense.functions.keep import keep
from relisense.functions.ordered import in_ranges, joined, ranges_for, rolling, with_position
from relisense.functions.quantiles import keyed_quantiles
from relisense.functions.columns import as_col
from relisense.operators.scores import coherence, z_baseline

WINDOW_S = 5.0
MILLISECONDS_FROM = 1e12


def epoch_seconds(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Divides a key's times by 1000 if their median is above 1e12, that is in milliseconds.

    Medians come from ``keyed_quantiles`` and are joined back, so a key's rows are not
    gathered in one task. Rows without a time stay.
    """
    med = keyed_quantiles(df, keys, t, {"_m": 0.5})
    return joined(df, med, keys, "left").withColumn(t, F.when(F.col("_m") > MILLISECONDS_FROM, F.col(t) / 1000).otherwise(F.col(t))).drop("_m")


def relative_time(df: DataFrame, order: str = "pos", t: str = "t") -> DataFrame:
    """Adds ``t_rel``: time since the least first-row time over a subject's channels."""
    first = df.groupBy("subject", "channel").agg(F.min_by(t, order).alias("_f")).groupBy("subject").agg(F.min("_f").alias("_t0"))
    return df.join(first, "subject").withColumn("t_rel", F.col(t) - F.col("_t0")).drop("_t0")


def window_index(t: Column | str, width: float = WINDOW_S) -> Column:
    return F.floor(as_col(t) / F.lit(float(width))).cast("long")


def window_signal(df: DataFrame, t: str = "t", width: float = WINDOW_S) -> DataFrame:
    """mean, std and n_samples per (subject, channel, win); n counts missing values too."""
    return df.groupBy("subject", "channel", window_index(t, width).alias("win")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n_samples"))


def window_multiaxis(df: DataFrame, t: str = "t", width: float = WINDOW_S) -> DataFrame:
    """std as the mean of the axes' deviations, and n_samples as the rows of the fullest axis."""
    axes = df.groupBy("subject", "channel", window_index(t, width).alias("win"), "axis").agg(F.stddev_samp("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return axes.groupBy("subject", "channel", "win").agg(F.avg("s").alias("std"), F.max("n").alias("n_samples"))


def raw_windows(df: DataFrame, t: str = "t", width: float = WINDOW_S) -> DataFrame:
    """Sorted samples per window, for every window from 0 to the last; empty ones are empty arrays."""
    w = window_index(t, width)
    have = df.where(w >= 0).groupBy("subject", "channel", w.alias("win")).agg(F.array_sort(F.collect_list("value")).alias("samples"))
    spine = have.groupBy("subject", "channel").agg(F.max("win").alias("_last")).select("subject", "channel", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("win"))
    return spine.join(have, ["subject", "channel", "win"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<double>")))


def window_annotation(df: DataFrame, offset: float = 0.0, t: str = "seconds", width: float = WINDOW_S, values: tuple[str, ...] = ("valence", "arousal")) -> DataFrame:
    """Mean of the value columns that exist, per (subject, rater, win)."""
    return df.groupBy("subject", "rater", window_index(F.col(t) + offset, width).alias("win")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values if v in df.columns])


def window_table(cells: DataFrame, core: list[str], aux: list[str], raters: DataFrame | None = None) -> DataFrame:
    """Wide table: rows are the windows in which any core channel has samples.

    Core channels are pivoted together, which gives the rows of a full outer join; auxiliary
    channels and raters (subject, win, rater, and value columns) only add columns.
    """

    def wide(channels: list[str], present: bool) -> DataFrame:
        aggs = [F.max(F.when(F.col("channel") == c, F.col(v))).alias(f"{c}_{v}") for c in channels for v in ("mean", "std", "n_samples")]
        return cells.where(F.col("channel").isin(channels)).groupBy("subject", "win").agg(*aggs)

    out = wide(core, True)
    if aux:
        out = out.join(wide(aux, False), ["subject", "win"], "left")
    if raters is not None:
        values = [c for c in raters.columns if c not in ("subject", "win", "rater", "n")]
        names = sorted(r["rater"] for r in raters.select("rater").distinct().collect())  # as many as there are raters
        wide_r = raters.groupBy("subject", "win").agg(*[F.max(F.when(F.col("rater") == r, F.col(v))).alias(f"{r}_{v}") for r in names for v in values])
        out = out.join(wide_r, ["subject", "win"], "left")
    return out


def subject_std(df: DataFrame, columns: list[str], key: str = "subject") -> DataFrame:
    """Adds ``{c}_subj_std``: sample deviation over all of the key's rows, joined back."""
    return df.join(df.groupBy(key).agg(*[F.stddev_samp(c).alias(f"{c}_subj_std") for c in columns]), key, "left")


def centred(df: DataFrame, columns: list[str], key: str | list[str] = "subject", suffix: str = "_c") -> DataFrame:
    """Adds each column less its mean over the key."""
    keys = [key] if isinstance(key, str) else key
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return df.join(means, keys, "left").withColumns({f"{c}{suffix}": F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def baseline_coherence(df: DataFrame, pairs: dict[str, tuple[str, str]], n_prev: list[int], key: str = "subject", order: str = "win") -> DataFrame:
    """Adds ``{name}_{n}`` for each pair of columns and each baseline length.

    The baseline is the mean of the previous n rows (gaps don't matter, missing values are
    left out); deviations are the subject's own.
    """
    columns = sorted({c for p in pairs.values() for c in p})
    out = subject_std(df, columns, key)

    def made(w) -> dict[str, Column]:
        return {f"_b_{c}_{n}": F.avg(c).over(w.rowsBetween(-n, -1)) for c in columns for n in n_prev}

    out = rolling(out, [key], order, max(n_prev), 0, made)
    z = lambda c, n: z_baseline(c, f"_b_{c}_{n}", F.nullif(F.col(f"{c}_subj_std"), F.lit(0.0)))
    out = out.withColumns({f"{name}_{n}": coherence(z(a, n), z(b, n)) for name, (a, b) in pairs.items() for n in n_prev})
    return out.drop(*[c for c in out.columns if c.startswith("_b_") or c.endswith("_subj_std") and c not in df.columns])


def rolling_std(df: DataFrame, columns: list[str], width: int = 5, least: int = 3, key: str = "subject", order: str = "win") -> DataFrame:
    """Adds ``{c}_rstd``: deviation over a centred frame with enough values."""
    half = width // 2

    def made(w) -> dict[str, Column]:
        f = w.rowsBetween(-half, half)
        return {f"{c}_rstd": F.when(F.count(c).over(f) >= least, F.stddev_samp(c).over(f)) for c in columns}

    return rolling(df, [key], order, half, half, made)


def shifted(df: DataFrame, column: str, by: list[int], key: str = "subject", order: str = "win") -> DataFrame:
    """Adds ``{c}_s{k}``: the value k rows earlier (later for negative k)."""
    made = lambda w: {f"{column}_s{k}": F.lag(column, k).over(w) if k >= 0 else F.lead(column, -k).over(w) for k in by}
    return rolling(df, [key], order, max([0, *by]), max([0, *[-k for k in by]]), made)


def assign_period(windows: DataFrame, times: DataFrame, width: float = WINDOW_S) -> DataFrame:
    """Adds ``period`` and ``win_in_period`` from (subject, init, start, end) in seconds.

    Windows from the start's to the end's are ``debate``, all others ``pre``; subjects
    without times are ``debate`` throughout.
    """
    at = lambda c: F.floor((F.col(c) - F.col("init")) / F.lit(float(width)))
    t = times.select("subject", at("start").alias("_w0"), at("end").alias("_w1"))
    out = windows.join(t, "subject", "left")
    inside = F.col("_w0").isNull() | F.col("win").between(F.col("_w0"), F.col("_w1"))
    out = out.withColumn("period", F.when(inside, "debate").otherwise("pre")).drop("_w0", "_w1")
    return with_position(out, ["subject", "period"], "win", "win_in_period")


def drop_first_windows(df: DataFrame, k: int) -> DataFrame:
    return df.where(F.col("win_in_period") >= k)


def nearest_grid(a: DataFrame, b: DataFrame, key: list[str], t: str = "t") -> DataFrame:
    """For each row of a (key, t) the distance to the nearest time of b with the same key; NULL if b has none.

    An as-of join in both directions over ranges of time: the distinct times of both are cut
    into ranges of about equal size per key. A range has one row with its first and last time
    of b, from which the last one before and the first one after each range are carried, so
    that a key's times are gone through by as many tasks as it has ranges. Rows without a time
    have no distance.
    """
    ours = a.groupBy(*key, t).agg(F.count(F.lit(1)).alias("_n"), F.lit(None).cast("double").alias("_b"))
    rows = keep(ours.unionByName(b.where(F.col(t).isNotNull()).select(*key, t).distinct().withColumns({"_n": F.lit(0).cast("long"), "_b": F.col(t).cast("double")})))
    placed = in_ranges(rows, key, t, ranges_for(rows.count()))
    ends = placed.groupBy(*key, "_range").agg(F.min("_b").alias("_first"), F.max("_b").alias("_last"))
    order = Window.partitionBy(*key).orderBy("_range")  # a row per range
    ends = ends.select(*key, "_range", F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    w = Window.partitionBy(*key, "_range").orderBy(t, F.col("_b").isNull())
    inside = placed.withColumn("_p", F.last("_b", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_f", F.first("_b", True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("_n > 0")
    both = joined(inside, ends, [*key, "_range"], "left").withColumns({"_p": F.coalesce("_p", "_before"), "_f": F.coalesce("_f", "_after")})
    distance = F.least(F.col(t) - F.col("_p"), F.col("_f") - F.col(t))
    return both.select(*key, t, distance.alias("distance"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("col")  # times that several rows share


def startup_latency(df: DataFrame, order: str = "pos", t: str = "t") -> DataFrame:
    """First-row time of each channel after the subject's earliest one."""
    first = df.groupBy("subject", "channel").agg(F.min_by(t, order).alias("_f"), F.count(F.lit(1)).alias("n"))
    t0 = first.groupBy("subject").agg(F.min("_f").alias("_t0"))
    return first.join(t0, "subject").select("subject", "channel", (F.col("_f") - F.col("_t0")).alias("latency"), "n")
