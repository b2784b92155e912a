"""Running sums, keyed quantiles and as-of distances over ranges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relisense.functions import ordered
from relisense.functions.quantiles import keyed_quantiles
from relisense.operators import classify, windows


@pytest.mark.parametrize("one_window", [0, 1000])
def test_running_sums(spark, monkeypatch, one_window):
    monkeypatch.setattr(ordered, "ONE_WINDOW", one_window)
    rng = np.random.default_rng(3)
    rows = [(k, float(v), int(rng.integers(0, 9))) for k in ("a", "b", None) for v in rng.permutation(300 if k == "a" else 7)]
    got = ordered.running_sums(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v", ["n"], ranges=5).collect()
    for k in ("a", "b", None):
        mine = sorted((r["v"], r["n"], r["n_before"]) for r in got if r["k"] == k)
        assert [x[2] for x in mine] == [0, *np.cumsum([x[1] for x in mine])[:-1].tolist()]
        assert len(mine) == (300 if k == "a" else 7)


@pytest.mark.parametrize("exact_rows", [0, 1000])
def test_keyed_quantiles(spark, monkeypatch, exact_rows):
    monkeypatch.setattr(ordered, "ONE_WINDOW", 10)
    rng = np.random.default_rng(4)
    rows = [("ties", float(rng.integers(0, 4))) for _ in range(101)] + [("many", float(x)) for x in rng.normal(0, 1, 240)] + [("one", 5.0), ("none", None), (None, 1.0), (None, 2.0)]
    fractions = {"low": 0.0, "q": 0.37, "mid": 0.5, "high": 1.0}
    got = {r["k"]: r for r in keyed_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", fractions, exact_rows).collect()}
    assert set(got) == {"ties", "many", "one", None}
    for k, r in got.items():
        values = [v for x, v in rows if x == k]
        assert all(r[name] == pytest.approx(np.quantile(values, q)) for name, q in fractions.items())


def test_nearest_time(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGES", 6)
    rng = np.random.default_rng(5)
    a = [(k, float(t)) for k in (1, 1, 1, 2, 3, None) for t in rng.integers(0, 400, 60)] + [(1, None)]
    b = [(k, float(t)) for k, n in ((1, 90), (2, 1), (None, 5)) for t in rng.uniform(100, 300, n)]
    make = lambda rows: spark.createDataFrame(rows, "k int, t double").repartition(3)
    got = sorted(((r["k"] or 0, -1.0 if r["t"] is None else r["t"], None if r["distance"] is None else round(r["distance"], 9)) for r in windows.nearest_grid(make(a), make(b), ["k"]).collect()), key=str)
    near = lambda k, t: min((round(abs(t - u), 9) for j, u in b if j == k), default=None) if t is not None else None
    assert got == sorted(((k or 0, -1.0 if t is None else t, near(k, t)) for k, t in a), key=str)


@pytest.mark.parametrize("one_window", [0, 1000])
def test_roc_and_precision(spark, monkeypatch, one_window):
    monkeypatch.setattr(ordered, "ONE_WINDOW", one_window)
    rng = np.random.default_rng(6)
    df = pd.DataFrame({"method": rng.choice(["a", "b"], 300), "label": rng.integers(0, 2, 300), "score": rng.integers(0, 40, 300).astype(float)})
    rows = spark.createDataFrame(df)
    points = classify.roc_points(rows, ["method"]).toPandas()
    ap = {r["method"]: r["ap"] for r in classify.average_precision(rows, ["method"]).collect()}
    for m, part in df.groupby("method"):
        want, last = 0.0, 0.0
        for s in sorted(part["score"].unique(), reverse=True):
            hit = part[part["score"] >= s]
            p = points[(points["method"] == m) & (points["threshold"] == s)].iloc[0]
            assert (p["tp"], p["fp"]) == (hit["label"].sum(), len(hit) - hit["label"].sum())
            tpr = hit["label"].sum() / part["label"].sum()
            want, last = want + (tpr - last) * hit["label"].mean(), tpr
        assert ap[m] == pytest.approx(want)
    assert rows.where(F.col("score") < 0).transform(lambda d: classify.roc_points(d, ["method"])).count() == 0
