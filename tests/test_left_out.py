"""Correlations without each subject against ranking the reduced tables."""

import numpy as np
import pandas as pd
import pytest

from relisense.operators import left_out


@pytest.mark.parametrize("at_once,ranges", [(128, 32), (3, 4)])
def test_equal_to_ranking_each_reduced_table(spark, monkeypatch, at_once, ranges):
    monkeypatch.setattr(left_out, "SUBJECTS_AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    rows = []
    for test, n, values in (("ties", 120, 6), ("many", 200, 10_000), ("constant", 30, 1), ("short", 3, 50)):
        for _ in range(n):
            s = int(rng.choice([0, 0, 0, 1, 2, 3, 4, 7]))
            rows.append((s, test, float(rng.integers(0, values)), float(rng.integers(0, values)) if values != 50 else 1.0 * len(rows)))
    rows += [(9, "ties", 2.0, None), (9, "many", None, 1.0), (None, "many", 1.0, 1.0)]
    got = {(r["test"], r["excluded"]): (r["n"], r["r"]) for r in left_out.loso_correlations(spark.createDataFrame(rows, "subject long, test string, x double, y double").repartition(3), ranges=ranges).collect()}
    df = pd.DataFrame(rows, columns=["s", "test", "x", "y"]).dropna()
    want = {}
    for test, part in df.groupby("test"):
        for s in part["s"].unique():
            rest = part[part["s"] != s]
            if len(rest) >= 3:
                x, y = rest["x"].rank(), rest["y"].rank()
                want[test, int(s)] = (len(rest), x.corr(y) if x.std() > 0 and y.std() > 0 else None)
    assert got.keys() == want.keys()
    for k, (n, r) in want.items():
        assert got[k][0] == n and (got[k][1] is None if r is None else got[k][1] == pytest.approx(r, abs=1e-9))


def test_no_rows(spark):
    assert left_out.loso_correlations(spark.createDataFrame([], "subject long, test string, x double, y double")).count() == 0
