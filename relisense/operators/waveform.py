"""Signal quality of multi-lead records, from (record, leads array<array<double>>) or long samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relisense.functions.columns import pearson

#: Deviation below which a lead counts as flat.
FLAT_STD = 1e-6


def long_leads(records: DataFrame, record: str = "record", leads: str = "leads") -> DataFrame:
    """(record, lead, i, v), NaN as NULL."""
    one = records.select(record, F.posexplode(leads).alias("lead", "_s")).select(record, "lead", F.posexplode("_s").alias("i", "v"))
    return one.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def std_signal(samples: DataFrame, record: str = "record") -> DataFrame:
    """(record, sigma): mean over leads of the population deviation."""
    return samples.groupBy(record, "lead").agg(F.stddev_pop("v").alias("s")).groupBy(record).agg(F.avg("s").alias("sigma"))


def std_window(samples: DataFrame, width: int, record: str = "record") -> DataFrame:
    """(record, sigma): median over full windows of the mean over leads; 0 without a full window."""
    per = samples.groupBy(record, "lead", F.floor(F.col("i") / F.lit(width)).alias("w")).agg(F.stddev_pop("v").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") == width)
    window = per.groupBy(record, "w").agg(F.avg("s").alias("s"))
    med = window.groupBy(record).agg(F.percentile("s", F.lit(0.5)).alias("sigma"))
    return samples.select(record).distinct().join(med, record, "left").fillna(0.0, ["sigma"])


def kurtosis_sqi(samples: DataFrame, record: str = "record") -> DataFrame:
    """(record, degenerate, ksqi): mean over leads of bias-corrected excess kurtosis; records
    with a flat lead are degenerate and have none."""
    n = F.count("v").cast("double")
    g2 = F.try_divide((n - 1) * ((n + 1) * F.kurtosis("v") + 6), (n - 2) * (n - 3))
    per = samples.groupBy(record, "lead").agg(F.stddev_pop("v").alias("s"), g2.alias("k"))
    out = per.groupBy(record).agg(F.coalesce(F.bool_or(F.coalesce(F.col("s"), F.lit(0.0)) < FLAT_STD), F.lit(True)).alias("degenerate"), F.avg("k").alias("ksqi"))
    out = out.withColumn("degenerate", F.col("degenerate") | F.col("ksqi").isNull() | F.isnan("ksqi"))
    return out.withColumn("ksqi", F.when(~F.col("degenerate"), F.col("ksqi")))


def lead_correlation(samples: DataFrame, record: str = "record") -> DataFrame:
    """(record, degenerate, corr): mean Pearson correlation over pairs of leads. Single-lead
    records have neither; a flat lead makes a record degenerate."""
    flat = samples.groupBy(record, "lead").agg(F.stddev_pop("v").alias("s")).groupBy(record).agg(F.count(F.lit(1)).alias("leads"), F.bool_or(F.coalesce(F.col("s"), F.lit(0.0)) < FLAT_STD).alias("degenerate"))
    # the leads of one sample are few: pairs are made inside the group, not by a join
    at = samples.groupBy(record, "i").agg(F.array_sort(F.collect_list(F.struct("lead", "v"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["lead"] > a["lead"]), lambda b: F.struct(a["lead"].alias("a"), b["lead"].alias("b"), a["v"].alias("x"), b["v"].alias("y")))))
    rows = at.select(record, F.explode(pairs).alias("_p")).select(record, "_p.*")
    corr = rows.groupBy(record, "a", "b").agg(pearson("x", "y").alias("r")).groupBy(record).agg(F.avg("r").alias("corr"))
    out = flat.join(corr, record, "left")
    return out.select(record, F.when(F.col("leads") >= 2, F.col("degenerate")).otherwise(False).alias("degenerate"), F.when((F.col("leads") >= 2) & ~F.col("degenerate"), F.col("corr")).alias("corr"))


def spectral_snr(records: DataFrame, signal: str, fs: str, fmin: float, fmax: float, name: str = "snr") -> DataFrame:
    """Adds the ratio in dB of power inside [fmin, fmax] to the rest.

    NULL for fewer than two samples or a band at or above half the rate; minus infinity for
    a signal without power.
    """

    def one(x, rate: float) -> float | None:
        v = np.asarray([] if x is None else x, dtype=float)
        v = v[~np.isnan(v)]
        if len(v) < 2 or rate is None or fmax >= rate / 2:
            return None
        power = np.abs(np.fft.rfft(v - v.mean())) ** 2
        f = np.fft.rfftfreq(len(v), 1 / rate)
        total = power[f > 0].sum()
        if total <= 0:
            return float("-inf")
        band = power[(f >= fmin) & (f <= fmax)].sum()
        if band <= 0:
            return float("-inf")
        return float(10 * np.log10(band / max(total - band, np.finfo(float).eps)))

    f = F.pandas_udf(lambda s, r: pd.Series([one(a, b) for a, b in zip(s, r, strict=True)], dtype="float64"), "double")
    return records.withColumn(name, f(F.col(signal), F.col(fs).cast("double")))


def beat_interval_std(records: DataFrame, signal: str, fs: str) -> DataFrame:
    """Adds rr_std and fail: population deviation of the intervals between beats, in seconds.

    Beats are found by band-limited squared slope with a refractory time of 0.25 s. Fewer than
    two beats give 0 and fail. This detector is a simple published scheme and is not meant to
    agree beat by beat with others.
    """

    def one(x, rate: float) -> tuple[float, bool]:
        v = np.nan_to_num(np.asarray([] if x is None else x, dtype=float))
        if len(v) < 3 or not rate:
            return 0.0, True
        width = max(1, int(0.12 * rate))
        energy = np.convolve(np.gradient(v - v.mean()) ** 2, np.ones(width) / width, "same")
        level, gap, beats = energy.mean() + 0.5 * energy.std(), max(1, int(0.25 * rate)), []
        for i in np.flatnonzero((energy[1:-1] >= energy[:-2]) & (energy[1:-1] > energy[2:]) & (energy[1:-1] > level)) + 1:
            if not beats or i - beats[-1] >= gap:
                beats.append(int(i))
        return (float(np.std(np.diff(beats) / rate)), False) if len(beats) >= 2 else (0.0, True)

    @F.pandas_udf("rr_std double, fail boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for s, r in batches:
            yield pd.DataFrame([one(a, b) for a, b in zip(s, r, strict=True)], columns=["rr_std", "fail"])

    return records.withColumn("_rr", run(F.col(signal), F.col(fs).cast("double"))).withColumn("rr_std", F.col("_rr.rr_std")).withColumn("fail", F.col("_rr.fail")).drop("_rr")


def record_features(records: DataFrame, record: str = "record") -> DataFrame:
    """(record, sigma, ksqi, corr, degenerate): everything the record study needs, to be kept once."""
    s = long_leads(records, record)
    k = kurtosis_sqi(s, record).withColumnRenamed("degenerate", "_k")
    c = lead_correlation(s, record).withColumnRenamed("degenerate", "_c")
    return std_signal(s, record).join(k, record).join(c, record).select(record, "sigma", "ksqi", "corr", (F.col("_k") | F.col("_c")).alias("degenerate"))
