"""Split-half calibration against records written out one by one."""

import numpy as np
import pytest

from relisense.operators import classify


def table(n=400, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, n)
    sigma = np.round(np.where(label == 1, rng.lognormal(0, 0.3, n), rng.lognormal(rng.choice([-2, 2], n), 0.4, n)), 1)
    return label, sigma


def plain(label, sigma, fit):
    """By the definition, on records; fit marks those that the score is calibrated on."""
    s = sigma[fit]
    eps = np.quantile(s[s > 0], 0.01)
    x = np.log(s[s >= eps] + 1e-9)
    med = np.median(x)
    mad = 1.4826 * np.median(np.abs(x - med)) or 1.0
    score = np.where(sigma < eps, 0.0, np.exp(-0.5 * ((np.log(sigma + 1e-9) - med) / mad) ** 2))
    a, b = score[~fit & (label == 1)], score[~fit & (label == 0)]
    return float(((a[:, None] > b) + 0.5 * np.isclose(a[:, None], b, rtol=1e-12)).mean())


def test_a_split_equals_its_records(spark):
    label, sigma = table()
    cells, n = np.unique(np.stack([sigma, label], axis=1), axis=0, return_counts=True)
    fit = np.random.default_rng(1).binomial(n, 0.5)
    records = np.repeat(cells, n, axis=0)
    mark = np.concatenate([np.arange(c) < k for c, k in zip(n, fit)])
    assert classify.split_auc(cells[:, 1], cells[:, 0], n, fit) == pytest.approx(plain(records[:, 1], records[:, 0], mark), abs=1e-9)
    assert classify.split_auc(np.ones(3), np.arange(3.0), np.ones(3, int), np.zeros(3, int)) is None


def test_layout_changes_nothing_and_both_ways_agree(spark):
    label, sigma = table()
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, sigma)] + [(None, 1.0), (1, None)], "label int, s double")
    one = {r["split"]: r["auc"] for r in classify.split_half(df, "s", splits=20).collect()}
    two = {r["split"]: r["auc"] for r in classify.split_half(df.repartition(7, "s"), "s", splits=20).collect()}
    assert one == two and len(one) == 20 and len(set(one.values())) > 10
    dealt = [r["auc"] for r in classify.split_half(df, "s", splits=20, cells_max=0).collect()]
    again = [r["auc"] for r in classify.split_half(df.repartition(5), "s", splits=20, cells_max=0).collect()]
    assert sorted(dealt) == pytest.approx(sorted(again)) and np.mean(dealt) == pytest.approx(np.mean(list(one.values())), abs=0.02)
