"""Beats in chunks are those of the whole record."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relisense.operators import beats, waveform


def signal(rng, n, fs):
    v = rng.normal(0, 0.05, n)
    at = np.cumsum(rng.uniform(0.1, 1.2, int(n / fs * 2)) * fs).astype(int)
    for a in at[at < n - 3]:
        v[a : a + 3] += (0.5, 1.0, 0.4)
    return v


@pytest.mark.parametrize("chunk", [40, 173, 100_000])
def test_any_chunk_length(spark, chunk):
    rng = np.random.default_rng(9)
    records = {1: (signal(rng, 2000, 100), 100.0), 2: (signal(rng, 901, 50), 50.0), 3: (np.zeros(300), 100.0), 4: (signal(rng, 37, 100), 100.0)}
    records[2][0][100] = np.nan
    whole = spark.createDataFrame([(k, v.tolist(), fs) for k, (v, fs) in records.items()], "record long, v array<double>, fs double")
    want = {r["record"]: r for r in waveform.beat_interval_std(whole, "v", "fs").collect()}
    samples = whole.select("record", "fs", F.posexplode("v").alias("i", "v")).repartition(5)
    got = {r["record"]: r for r in beats.long_beat_intervals(samples, chunk).collect()}
    assert got.keys() == want.keys() and got[1]["beats"] > 15
    for k, r in got.items():
        assert r["rr_std"] == pytest.approx(want[k]["rr_std"], abs=1e-9) and r["fail"] == want[k]["fail"]
