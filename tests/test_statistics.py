import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relisense.functions import special
from relisense.operators import classify, mixed, models, quality, ranks, variance


def test_tails():
    assert special.norm_sf(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert special.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.t_sf2(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-7)
    assert special.chi2_sf(18.30704, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.chi2_sf(1.0, 1) == pytest.approx(math.erfc(math.sqrt(0.5)), abs=1e-12)
    assert special.wilcoxon_p(8, 3, 0, False) == pytest.approx(10 / 256)
    assert special.wilcoxon_p(6, 0, 0, False) == pytest.approx(2 / 64)
    assert special.correlation_p(1.0, 10) == 0.0 and special.correlation_p(0.5, 2) is None


def test_average_ranks(spark):
    rows = [("a", x) for x in (3.0, 1.0, 3.0, 2.0, None)] + [("b", float(x % 40)) for x in range(1000)]
    out = ranks.average_rank(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", "r").collect()
    a = sorted((r["x"], r["r"]) for r in out if r["k"] == "a" and r["x"] is not None)
    assert a == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]
    assert all(r["r"] == 25 * r["x"] + 13 for r in out if r["k"] == "b")
    assert [r["r"] for r in out if r["x"] is None] == [None]


def test_spearman_is_monotone_invariant(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=80)
    df = spark.createDataFrame([(float(a), float(np.exp(a)), float(a + b)) for a, b in zip(x, rng.normal(size=80), strict=True)], "x double, e double, y double")
    t = {r["test"]: r["r"] for r in ranks.correlations(ranks.long_pairs(df, {"same": ("x", "e"), "p": ("x", "y"), "q": ("e", "y")}), ["test"]).collect()}
    assert t["same"] == pytest.approx(1.0) and t["p"] == pytest.approx(t["q"])


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5), (5, None)], "t int, p double")
    out = {r["t"]: r for r in ranks.adjust(df).collect()}
    assert [out[i]["p_fdr"] for i in (1, 2, 3, 4)] == pytest.approx([0.04, 0.0533333333, 0.0533333333, 0.5])
    assert out[1]["p_bonferroni"] == pytest.approx(0.04) and out[5]["p_fdr"] is None and out[1]["reject_fdr"]


def test_kruskal(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4)] + [("b", float(v)) for v in (5, 6, 7, 8)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("test", F.lit(1))
    t = ranks.kruskal(df, ["test"], "g", "v")
    p = ranks.with_chi2_p(t.withColumn("df", F.col("k") - 1), "h", "df").first()["p"]
    assert p == pytest.approx(special.chi2_sf(5.3333333, 1), abs=1e-6)
    r = t.first()
    assert r["h"] == pytest.approx(5.3333333) and r["k"] == 2 and r["n"] == 8


def test_partial_correlation_removes_the_control(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=400)
    rows = [(1, float(a + 0.1 * b), float(a + 0.1 * c), float(a)) for a, b, c in zip(z, rng.normal(size=400), rng.normal(size=400), strict=True)]
    df = spark.createDataFrame(rows, "k int, x double, y double, z double")
    assert abs(ranks.partial_from_moments(df, ["k"], "x", "y", ["z"]).first()["r"]) < 0.12
    constant = df.withColumn("z", F.lit(1.0))
    assert ranks.partial_from_moments(constant, ["k"], "x", "y", ["z"]).first()["r"] is None


def test_icc_of_pure_groups(spark):
    df = spark.createDataFrame([("m", g, float(g)) for g in range(5) for _ in range(4)], "metric string, g int, v double")
    assert variance.one_way_icc(df, ["metric"], "g", "v").first()["icc"] == pytest.approx(1.0)
    assert variance.one_way_icc(df.where("g = 1"), ["metric"], "g", "v").first()["icc"] is None


def labelled(spark, seed=0, n=500):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    return spark.createDataFrame([(int(a), float(a + b), float(c)) for a, b, c in zip(y, rng.normal(0, 0.3, n), rng.normal(size=n), strict=True)], "label int, good double, noise double")


def test_same_score_does_not_differ(spark):
    r = classify.delong(labelled(spark), "good", "good").first()
    assert abs(r["diff"]) < 1e-9 and r["p"] > 0.99


def test_signal_differs_from_noise(spark):
    df = labelled(spark)
    r = classify.delong(df, "good", "noise").first()
    b = classify.bootstrap_auc(df, "good", "noise", replicas=300).first()
    assert r["diff"] > 0.2 and r["p"] < 0.001 and b["ci_low"] > 0 and b["diff"] == pytest.approx(r["diff"])


def u_shaped(spark):
    rng = np.random.default_rng(5)
    rows = [(1, float(v)) for v in rng.lognormal(0, 0.3, 773)] + [(0, float(v)) for v in rng.uniform(0.0005, 0.01, 112)] + [(0, float(v)) for v in rng.lognormal(2.2, 0.3, 113)]
    return spark.createDataFrame(rows, "label int, sigma double")


def test_u_shaped_population(spark):
    from relisense.operators.scores import UScore

    df = u_shaped(spark)
    m = UScore.fit(df, ["sigma"])["sigma"]
    rows = classify.long_scores(df.withColumn("u", m.score("sigma")).withColumn("d", m.score("sigma", shape="mono")), ["u", "d"])
    auc = {r["method"]: r["auc"] for r in classify.auc(rows, ["method"]).collect()}
    assert auc["u"] > 0.85
    assert auc["u"] == pytest.approx(auc["d"], abs=1e-3)
    assert classify.split_summary(classify.split_half(df, "sigma", splits=40)).first()["mean"] > 0.75


def test_errors_gather_in_the_overlap(spark):
    from relisense.operators.scores import UScore

    rng = np.random.default_rng(6)
    rows = [(1, float(v)) for v in rng.lognormal(0, 0.3, 700)] + [(0, float(v)) for v in np.concatenate([rng.uniform(0.0005, 0.01, 100), rng.lognormal(0.05, 0.35, 100), rng.lognormal(3, 0.3, 100)])]
    df = spark.createDataFrame(rows, "label int, sigma double")
    df = df.withColumn("u", UScore.fit(df, ["sigma"])["sigma"].score("sigma"))
    z = {r["part"]: r["in_zone"] for r in classify.overlap_analysis(df, "sigma", "u").collect()}
    assert z["false_positive"] > z["class_0"]


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", 1, 0.7)], "method string, label int, score double")
    assert classify.auc(df, ["method"]).first()["auc"] is None
    c = classify.confusion(df, ["method"], 0.6).first()
    assert (c["sensitivity"], c["specificity"], c["gmean"]) == (0.5, 0.0, 0.0)


def test_mixed_model_recovers_the_effect(spark):
    rng = np.random.default_rng(7)
    rows = [(s, float(x), float(2 * x + b + e)) for s in range(20) for b in [rng.normal(0, 1)] for x, e in zip(rng.integers(0, 2, 40), rng.normal(0, 0.5, 40), strict=True)]
    df = spark.createDataFrame(rows, "subject int, x double, y double")
    sums = models.subject_sums(df, "y", "x").toPandas()
    m = models.mixed_model(sums)
    assert m["beta"] == pytest.approx(2, abs=0.1) and 0.6 < m["icc"] < 0.95 and m["p"] < 1e-10 and m["converged"]
    by_grid = mixed.mixed_models(df.withColumn("k", F.lit("a")).unionByName(df.where("subject < 2").withColumn("k", F.lit("few"))), ["k"]).collect()
    assert len(by_grid) == 1 and by_grid[0]["n"] == 800 and by_grid[0]["subjects"] == 20 and not by_grid[0]["sign_flip"]
    assert by_grid[0]["beta"] == pytest.approx(m["beta"], abs=0.01 * m["se"]) and by_grid[0]["se"] == pytest.approx(m["se"], rel=0.01) and by_grid[0]["icc"] == pytest.approx(m["icc"], abs=0.02)
    without = [models.mixed_model(sums[sums["subject"] != s])["beta"] for s in range(20)]
    assert by_grid[0]["loso_min"] == pytest.approx(min(without), abs=0.01 * m["se"]) and by_grid[0]["loso_max"] == pytest.approx(max(without), abs=0.01 * m["se"])
    assert math.isnan(models.mixed_model(sums.head(2))["beta"])
    t = models.ols(df, "y", ["x"], standardise=False)
    assert t["beta"][0] == pytest.approx(2, abs=0.3) and t["p"][0] < 1e-6


def test_task_validity(spark):
    rng = np.random.default_rng(8)
    rows = [(s, w, w, "debate" if w >= 20 else "pre", float((w >= 20) + rng.normal(0, 0.3))) for s in range(6) for w in range(40)]
    t = models.task_validity(spark.createDataFrame(rows, "subject int, win long, win_in_period long, period string, v double"), ["v"], drops=(1,)).toPandas()
    assert t["beta"][0] == pytest.approx(1, abs=0.15) and t["wilcoxon_positive"][0] == 6 and t["wilcoxon_p"][0] == pytest.approx(2 / 64) and t["coverage_pre"][0] == 1.0


def test_parse_fraction(spark):
    cells = ["0.998", "4007 (0.994)", "n/a", "NA", "", " ", "broken", None, "NaN", "(1.2.3)", "-0.5"]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(quality.parse_fraction("c")).collect()]
    assert got == [0.998, 0.994, None, None, None, None, None, None, None, None, -0.5]


def test_thresholds_are_strict_and_missing_never_flags(spark):
    df = spark.createDataFrame([(1, 0.90, 0.20, 0.10, 1.0), (2, 0.89, 0.21, 0.11, 1.0), (3, None, None, None, None)], "subject int, completeness_a double, zeros_a double, outliers_a double, durations_a double")
    assert {(r["subject"], r["reason"]) for r in quality.low_quality(df, ["a"]).collect()} == {(2, "completeness"), (2, "zeros"), (2, "outliers")}
