"""Tails as column expressions against the scalar functions and known values."""

import pytest
from pyspark.sql import functions as F

from relisense.functions import special, tails


def close(a, b):
    return a == pytest.approx(b, rel=1e-9, abs=1e-12)


def test_student_and_correlations(spark):
    cases = [(t, df) for df in (1, 2, 3, 10, 77, 700, 20_000, 99_000) for t in (0.0, 0.01, 0.7, -1.96, 5.0, 40.0)]
    rows = spark.createDataFrame(cases, "t double, df int").select("t", "df", tails.t_sf2(F.col("t"), F.col("df")).alias("p")).collect()
    assert len(rows) == len(cases) and all(close(r["p"], special.t_sf2(r["t"], r["df"])) for r in rows)
    far = spark.createDataFrame([(1.959963984540054, 10**9), (3.0, 200_000)], "t double, df long").select(tails.t_sf2(F.col("t"), F.col("df")).alias("p")).collect()
    assert far[0]["p"] == pytest.approx(0.05, abs=1e-9)
    assert far[1]["p"] == pytest.approx(special.t_sf2(3.0, 200_000), rel=1e-9)
    pairs = [(0.3, 20), (None, 20), (0.3, 2), (1.0, 9), (-1.0, 9), (-0.02, 5000), (0.0, 10)]
    got = [r["p"] for r in spark.createDataFrame(pairs, "r double, n int").coalesce(1).select(tails.correlation_p("r", "n", 1).alias("p")).collect()]
    assert all((g is None and (w := special.correlation_p(*p, 1)) is None) or close(g, special.correlation_p(*p, 1)) for g, p in zip(got, pairs))


def test_chi_square_and_normal(spark):
    cases = [(x, df) for df in (1, 2, 5, 60, 900) for x in (0.0, 0.001, 0.5, 3.84, 60.0, 899.0, 1200.0)]
    rows = spark.createDataFrame(cases, "x double, df int").select("x", "df", tails.chi2_sf(F.col("x"), F.col("df")).alias("p"), tails.norm_sf2(F.col("x") / 100).alias("z")).collect()
    for r in rows:
        assert close(r["p"], special.chi2_sf(r["x"], r["df"]))
        assert close(r["z"], 2 * special.norm_sf(r["x"] / 100))


def test_signed_ranks(spark):
    cases = [(n, float(w), 0.0, False) for n in (1, 2, 3, 5, 12, 50) for w in (0, 1, n * (n + 1) // 4, n * (n + 1) // 2)] + [(5, 7.5, 6.0, True), (60, 500.0, 0.0, False), (3, 3.0, 24.0, True), (0, 0.0, 0.0, None)]
    rows = spark.createDataFrame(cases, "n int, w_plus double, tie_term double, ties boolean").withColumn("p", tails.wilcoxon_p(F.col("n"), F.col("w_plus"), F.col("tie_term"), F.col("ties"))).collect()
    for r in rows:
        want = special.wilcoxon_p(r["n"], r["w_plus"], r["tie_term"], bool(r["ties"])) if r["n"] >= 3 else None
        assert (r["p"] is None and want is None) or close(r["p"], want)
