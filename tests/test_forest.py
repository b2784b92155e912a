"""Forests of all folds at once against trees grown one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relisense.operators import forest, learning

LEAF, DEPTH, TREES, SEED = 3, 3, 4, 7


def one_tree(x, y, w, depth):
    """A tree as nested tuples: (input, cut, left, right) or the mean."""
    mean = (w * y).sum() / w.sum()
    best = None
    for f in range(x.shape[1]):
        for cut in sorted(set(x[:, f]))[:-1]:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) < LEAF:
                continue
            gain = (w * y)[low].sum() ** 2 / w[low].sum() + (w * y)[~low].sum() ** 2 / w[~low].sum() - (w * y).sum() ** 2 / w.sum()
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = gain, f, cut, low
    if not depth or best is None:
        return mean
    _, f, cut, low = best
    return f, cut, one_tree(x[low], y[low], w[low], depth - 1), one_tree(x[~low], y[~low], w[~low], depth - 1)


def guess(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def table(spark, subjects=4, each=25, holes=False):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(subjects):
        for i in range(each):
            a, b = int(rng.integers(0, 12)), int(rng.integers(0, 9))
            rows.append((s, i, float(a), None if holes and i % 7 == 0 else float(b), float(a * (b > 4) + rng.normal(0, 0.3)), float(rng.random()), float(rng.integers(1, 4))))
    return spark.createDataFrame(rows, "subject int, win int, a double, b double, y double, score double, w double")


def test_equal_to_single_trees(spark):
    df = table(spark)
    weights = {"base": F.lit(1.0), "weight": F.col("w"), "filter": (F.col("score") > 0.5).cast("double")}
    out = forest.leave_one_out_forests(df.repartition(3), ["a", "b"], "y", weights, {"random": "filter"}, trees=TREES, depth=DEPTH, leaf=LEAF, seed=SEED).collect()
    got = {(r["treatment"], r["subject"], r["y"]): r["x"] for r in out}
    assert len(out) == len(got) == 4 * 100
    hashed = df.select("*", F.xxhash64(F.lit(SEED), *df.columns).alias("h")).withColumn("u", F.pmod(F.xxhash64(F.lit(SEED + 1), "h"), F.lit(1 << 20)) / float(1 << 20)).toPandas()
    x, y, s = hashed[["a", "b"]].to_numpy(), hashed["y"].to_numpy(), hashed["subject"].to_numpy()
    own = {"base": np.ones(len(y)), "weight": hashed["w"].to_numpy(), "filter": (hashed["score"] > 0.5).to_numpy(float)}
    for held in range(4):
        share = own["filter"][s != held].mean()
        for name in (*own, "random"):
            weight = own.get(name, (hashed["u"].to_numpy() < share).astype(float))
            trees = []
            for b in range(TREES):
                w = weight * forest.draws(hashed["h"].to_numpy(), b, SEED)
                on = (w > 0) & (s != held)
                trees.append(one_tree(x[on], y[on], w[on], DEPTH))
            for i in np.flatnonzero(s == held):
                assert got[name, held, y[i]] == pytest.approx(np.mean([guess(t, x[i]) for t in trees]), rel=1e-9)


def test_slices_and_groups_change_nothing(spark, monkeypatch):
    df = table(spark, holes=True)
    run = lambda: {(r["subject"], r["y"]): round(r["x"], 9) for r in forest.leave_one_out_forests(df, ["a", "b"], "y", {"base": F.lit(1.0)}, trees=5, depth=3, leaf=2).collect()}
    whole = run()
    assert len(whole) == 100
    monkeypatch.setattr(forest, "SLICE_ROWS", 9)
    monkeypatch.setattr(forest, "FOLDS_TOGETHER", 3)
    monkeypatch.setattr(forest, "SUBJECTS_AT_ONCE", 3)
    assert run() == whole


def test_draws_have_mean_and_variance_of_one():
    d = np.concatenate([forest.draws(np.arange(5000) * 977 - 10**6, t, 1) for t in range(20)])
    assert abs(d.mean() - 1) < 0.01 and abs(d.var() - 1) < 0.02


def test_few_jobs_and_nothing_to_train_on(spark):
    df = table(spark, subjects=3)
    out = forest.leave_one_out_forests(df, ["a"], "y", {"never": F.lit(0.0), "base": F.lit(1.0)}, trees=2)
    assert {r["treatment"] for r in out.collect()} == {"base"}
    assert forest.leave_one_out_forests(df.limit(0), ["a"], "y", {"base": F.lit(1.0)}).count() == 0
    summary = {(r["treatment"], r["metric"]): r for r in learning.fold_summary(learning.loso_predictions(df.withColumn("w_var", F.lit(1.0)), ["a", "b"], "y", "score", trees=3)).collect()}
    assert len(summary) == 15 and summary["base", "ccc"]["wilcoxon_p"] is None and summary["filter", "ccc"]["folds"] == 3
    assert summary["variance_weight", "ccc"]["delta_mean"] == pytest.approx(0, abs=1e-12)  # equal weights change nothing
