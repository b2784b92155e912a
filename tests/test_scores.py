import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relisense.functions.columns import nan_to_null, pearson, row_mean
from relisense.functions.ordered import rolling, with_position
from relisense.functions.quantiles import quantiles
from relisense.operators import scores
from relisense.operators.scores import Monotone, UScore, coherence, composite, composite_imputed, plausibility_gate, plausible_share, snr_reliability, z_baseline


def numpy_u(x):
    eps = np.percentile(x[x > 0], 1)
    logs = np.log(x[x >= eps] + 1e-9)
    med = np.median(logs)
    mad = 1.4826 * np.median(np.abs(logs - med)) or 1.0
    return np.where(x < eps, 0.0, np.exp(-0.5 * ((np.log(x + 1e-9) - med) / mad) ** 2))


def one_column(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i long, x double")


def test_u_score_equals_its_definition(spark):
    x = np.concatenate([np.random.default_rng(0).lognormal(0, 1, 300), [0.0, 0.0, 1e-12]])
    df = one_column(spark, x)
    got = df.select("i", UScore.fit(df, ["x"])["x"].score("x").alias("u")).orderBy("i").toPandas()["u"]
    assert np.allclose(got, numpy_u(x), atol=1e-12)


def test_u_score_missing_values_and_degenerate_populations(spark):
    df = one_column(spark, [1.0, 2.0, None, 4.0])
    m = UScore.fit(df, ["x"])["x"]
    assert [r[0] for r in df.orderBy("i").select(m.score("x")).collect()][2] is None
    assert [r[0] for r in df.orderBy("i").select(m.score("x", "one")).collect()][2] == 1.0
    same = one_column(spark, [3.0] * 5)
    assert {r[0] for r in same.select(UScore.fit(same, ["x"])["x"].score("x")).collect()} == {1.0}
    flat = one_column(spark, [0.0] * 5)
    assert UScore.fit(flat, ["x"])["x"].eps == scores.FLAT_FALLBACK
    assert {r[0] for r in flat.select(UScore.fit(flat, ["x"])["x"].score("x")).collect()} == {0.0}
    assert UScore.fit(df.limit(0), ["x"])["x"].med == 0.0


def test_u_score_does_not_depend_on_the_unit(spark):
    x = np.random.default_rng(1).lognormal(2, 1, 200)
    a, b = (one_column(spark, v) for v in (x, x * 1000))
    ua, ub = (d.select("i", UScore.fit(d, ["x"])["x"].score("x").alias("u")).orderBy("i").toPandas()["u"] for d in (a, b))
    assert np.allclose(ua, ub, atol=1e-6)


def test_monotone(spark):
    df = one_column(spark, [1, 2, 3, 4, 100, None])
    m = Monotone.fit(df, {"up": ("x", 1)})["up"]
    got = [r[0] for r in df.orderBy("i").select(m.score("x")).collect()]
    assert got[0] == got[2] == 0.0 and got[4] > got[3] > 0 and got[5] is None
    assert got[3] == pytest.approx(1 - math.exp(-(1 / 1.4826) / 2))


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 0.5, 2.0), (None, 0.4, 0.0)], "a double, b double, s double")
    r = df.select(z_baseline("a", "b", "s").alias("z"), coherence(F.lit(1.0), F.lit(3.0)).alias("v"), row_mean(["a", "b"]).alias("m"), plausibility_gate("a", "b").alias("g"), snr_reliability(F.lit(float("-inf"))).alias("n"), snr_reliability(F.lit(10.0)).alias("h"), plausible_share(F.array(F.lit(1.0), F.lit(None), F.lit(5.0)), 0, 2).alias("p")).collect()
    assert (r[0]["z"], r[0]["v"], r[0]["m"], r[0]["g"]) == (0.25, pytest.approx(math.exp(-1)), 0.75, 1.0)
    assert (r[1]["z"], r[1]["m"], r[1]["g"]) == (None, 0.4, 0.0)
    assert (r[0]["n"], r[0]["h"], r[0]["p"]) == (0.0, 0.5, 0.5)
    with pytest.raises(ValueError):
        composite(["a", "b"], [0.5, 0.6])


def test_composite_imputes_each_leg(spark):
    df = spark.createDataFrame([(0.2, None, 0.4), (0.4, 0.5, None), (None, 0.7, 0.8)], "e double, c double, d double")
    out = composite_imputed(df, "e", "c", "d").orderBy("d").collect()
    assert out[0]["score"] == pytest.approx((0.4 + 0.5 + 0.6) / 3)
    assert composite_imputed(df, "e", "c", None).where("c is null").first()["score"] == pytest.approx((0.2 + 0.6) / 2)


def test_quantiles_by_brackets_are_exact(spark):
    x = np.random.default_rng(2).normal(0, 1, 30_000).round(3)
    df = one_column(spark, x)
    for q in (0.0, 0.01, 0.5, 0.777, 1.0):
        assert quantiles(df, {"q": ("x", q)}, exact_rows=2000)["q"] == pytest.approx(np.percentile(x, 100 * q), abs=1e-12)
    assert quantiles(df.limit(0), {"q": ("x", 0.5)})["q"] is None


def test_rolling_over_chunks_equals_one_window(spark, monkeypatch):
    from relisense.functions import ordered

    monkeypatch.setattr(ordered, "CHUNK", 7)
    rows = [(s, w * (3 if s else 1), float((w * 37) % 11) if w % 5 else None) for s in range(2) for w in range(60)]
    df = spark.createDataFrame(rows, "subject int, win long, x double")
    assert {(r["subject"], r["win"]): r["_pos"] for r in with_position(df, ["subject"], "win").collect()} == {(s, w * (3 if s else 1)): w for s in range(2) for w in range(60)}
    got = rolling(df, ["subject"], "win", 3, 2, lambda w: {"a": F.avg("x").over(w.rowsBetween(-3, -1)), "b": F.count("x").over(w.rowsBetween(-2, 2))}).collect()
    assert len(got) == 120
    at = {(s, w): x for s, w, x in rows}
    for r in got:
        step = 3 if r["subject"] else 1
        near = lambda a, b: [v for k in range(a, b + 1) if (v := at.get((r["subject"], r["win"] + k * step))) is not None]  # noqa: B023, E731
        before = near(-3, -1)
        assert r["a"] == (pytest.approx(sum(before) / len(before)) if before else None) and r["b"] == len(near(-2, 2))


def test_nan_and_constant_columns(spark):
    df = nan_to_null(spark.createDataFrame([(1.0, float("nan")), (2.0, 5.0)], "a double, b double"))
    assert df.where("b is null").count() == 1
    assert spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double").agg(pearson("a", "b")).first()[0] is None
