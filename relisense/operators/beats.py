"""Beats of long records, sample by sample, in chunks.

The scheme is that of ``waveform.beat_interval_std``: peaks of the smoothed squared slope above
a level of the whole record, at least a refractory time apart. A record's samples are cut into
chunks that also get the few samples their slopes and averages reach into. What is left of a
chunk is its peaks. Whether a peak counts as a beat depends on the beat before it, so a chunk
lists, for every peak that could be its first beat, where its last one then is; chunks are
chained by these short lists, and the choice is the same for any length of chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relisense.functions.keep import keep

SMOOTH_S, REFRACTORY_S = 0.12, 0.25
CHUNK = 50_000


def _peaks(samples: DataFrame, chunk: int) -> DataFrame:
    """(record, fs, chunk, n, e, ee, at, height): per chunk the count and sums of its energies, and its peaks as arrays."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("i")
        v, i, own = g["v"].to_numpy(), g["i"].to_numpy(), (g["in"] == g["chunk"]).to_numpy()
        width = max(1, int(SMOOTH_S * g["fs"].iloc[0]))
        energy = np.convolve(np.gradient(v) ** 2, np.ones(width) / width, "full")[(width - 1) // 2 :][: len(v)] if len(v) > 1 else np.zeros(len(v))
        top = np.zeros(len(v), dtype=bool)
        top[1:-1] = (energy[1:-1] >= energy[:-2]) & (energy[1:-1] > energy[2:])
        top &= own
        e = energy[own]
        first = g.iloc[0]
        return pd.DataFrame({"record": [first["record"]], "fs": [first["fs"]], "chunk": [first["in"]], "n": [int(own.sum())], "e": [e.sum()], "ee": [(e * e).sum()], "at": [i[top].tolist()], "height": [energy[top].tolist()]})

    fs = F.max("fs").alias("_fs")
    mean = samples.groupBy("record").agg(F.avg(F.coalesce(F.nanvl("v", F.lit(None).cast("double")), F.lit(0.0))).alias("_mean"), F.max("i").alias("_last"), fs)
    reach = (F.floor(SMOOTH_S * F.col("_fs")) + 3).cast("long")
    rows = samples.join(mean, "record").select("record", "i", F.col("_fs").alias("fs"), (F.coalesce(F.nanvl("v", F.lit(None).cast("double")), F.lit(0.0)) - F.col("_mean")).alias("v"), F.floor(F.col("i") / chunk).alias("chunk"), reach.alias("_reach"), F.floor(F.col("_last") / chunk).alias("_end"))
    near = F.sequence(F.greatest(F.floor((F.col("i") - F.col("_reach")) / chunk), F.lit(0)), F.least(F.floor((F.col("i") + F.col("_reach")) / chunk), F.col("_end")))
    spread = rows.withColumn("in", F.explode(near)).drop("_reach", "_end")
    return spread.groupBy("record", "in").applyInPandas(run, f"record {dict(samples.dtypes)['record']}, fs double, chunk long, n long, e double, ee double, at array<long>, height array<double>")


def _choices(at: np.ndarray, gap: int) -> list[tuple]:
    """(first, last, beats, sum, sum of squares of intervals) for each peak that can be a chunk's first beat."""
    out = []
    for k in range(len(at)):
        if k and at[k - 1] >= at[0] + gap:  # the one before, or an earlier one, would have been taken
            break
        last, n, s, ss = int(at[k]), 1, 0.0, 0.0
        j = k
        while (j := j + int(np.searchsorted(at[j:], last + gap))) < len(at):
            d = float(at[j] - last)
            last, n, s, ss = int(at[j]), n + 1, s + d, ss + d * d
        out.append((int(at[k]), last, n, s, ss))
    return out


def long_beat_intervals(samples: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(record, beats, rr_std, fail) from (record, i, v, fs), a row per sample numbered from 0.

    rr_std: population deviation of the intervals between beats, in seconds; fewer than two
    beats give 0 and fail. Missing samples count as 0. A task holds a chunk of samples, or the
    list of a record's chunks.
    """
    peaks = keep(_peaks(samples, chunk))
    whole = Window.partitionBy("record")  # a row per chunk
    mean = F.sum("e").over(whole) / F.sum("n").over(whole)
    var = F.greatest(F.sum("ee").over(whole) / F.sum("n").over(whole) - mean * mean, F.lit(0.0))
    high = F.filter(F.arrays_zip("at", "height"), lambda p: p["height"] > F.col("level"))
    kept = peaks.withColumn("level", mean + 0.5 * F.sqrt(var)).select("record", "fs", "chunk", F.transform(high, lambda p: p["at"]).alias("at"))

    def choices(batches):
        for b in batches:
            gaps = [max(1, int(REFRACTORY_S * f)) for f in b["fs"]]
            lists = [[dict(zip(("first", "last", "n", "s", "ss"), c)) for c in _choices(np.asarray(a, dtype=np.int64), g)] for a, g in zip(b["at"], gaps)]
            yield pd.DataFrame({"record": b["record"], "fs": b["fs"], "chunk": b["chunk"], "gap": gaps, "choices": lists})

    each = "array<struct<first:bigint,last:bigint,n:bigint,s:double,ss:double>>"
    listed = kept.mapInPandas(choices, f"record {dict(samples.dtypes)['record']}, fs double, chunk long, gap long, choices {each}")
    chained = listed.groupBy("record", "fs", "gap").agg(F.array_sort(F.collect_list(F.struct("chunk", "choices"))).alias("chunks"))
    begin = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"))

    def follow(a, c):
        """The first peak of the chunk that the refractory time allows, and what follows from it."""
        took = F.get(F.filter(c["choices"], lambda x: a["last"].isNull() | (x["first"] - a["last"] >= F.col("gap"))), F.lit(0))
        d = F.coalesce((took["first"] - a["last"]).cast("double"), F.lit(0.0))
        return F.when(took.isNull(), a).otherwise(F.struct(took["last"].alias("last"), (a["n"] + took["n"]).alias("n"), (a["s"] + took["s"] + d).alias("s"), (a["ss"] + took["ss"] + d * d).alias("ss")))

    t = chained.select("record", "fs", F.aggregate("chunks", begin, follow).alias("t"))
    k = F.col("t.n") - 1
    spread = F.sqrt(F.greatest(F.col("t.ss") / k - (F.col("t.s") / k) ** 2, F.lit(0.0))) / F.col("fs")
    return t.select("record", F.col("t.n").alias("beats"), F.when(k >= 1, spread).otherwise(0.0).alias("rr_std"), (k < 1).alias("fail"))
