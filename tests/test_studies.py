import numpy as np
from pyspark.sql import functions as F

from relisense.plans import studies


def test_window_study(spark):
    rng = np.random.default_rng(0)
    rows = [(s, c, 1000.0 + i, float(rng.normal(s, 1 + (i % 5))), i) for s in range(4) for c in ("hr", "eda", "attention", "acc") for i in range(150)]
    f = studies.window_features(spark.createDataFrame(rows, "subject int, channel string, t double, value double, pos long"), ["hr", "eda"], ["attention", "acc"])
    scored = studies.score_windows(f)
    assert scored.count() == 4 * 30 and scored.where("score is null or score < 0 or score > 1").count() == 0
    out = studies.window_study(scored.withColumn("y", F.col("hr_mean") * 2), ["y"], spark.createDataFrame([(3,)], "subject int"))
    assert out["windows"].count() == 3 and out["leverage"].first()["target"] == "y" and out["components"].count() > 3
    assert studies.confound_control(scored, "S_estab", "hr_mean", ["eda_mean"]).count() >= 1
    assert studies.partial_within(scored, "S_estab", "hr_mean", ["eda_mean"]).first()["n"] == 120
    times = spark.createDataFrame([(s, 0.0, 50.0, 200.0) for s in range(4)], "subject int, init double, start double, end double")
    assert studies.task_study(scored, times, ["S_estab"]).first()["column"] == "S_estab"


def test_trial_study(spark):
    rng = np.random.default_rng(1)
    hr = spark.createDataFrame([(i, s, float(rng.normal(ord(s), 1))) for i in range(80) for s in ("a", "b")], "item int, subject string, hr double")
    et = spark.createDataFrame([(i, s, float(rng.normal(i / 40, 1))) for i in range(10, 90) for s in ("a", "b")], "item int, subject string, pupil double")
    lab = spark.createDataFrame([(i, str(rng.integers(0, 3))) for i in range(90) for _ in range(6)], "item int, label string")
    out = studies.trial_study(hr, et, lab, ["hr", "pupil"])
    assert out["items"].count() == 70 and out["tests"].where("p_fdr is not null").count() == 4
    assert out["variance"].where("metric = 'hr'").first()["icc_subject"] > 0.1 and out["pairs"].count() == 2 and out["viewers"].first()["two"] == 70


def test_record_study(spark):
    rng = np.random.default_rng(2)
    rows, truth = [], []
    for i in range(60):
        scale = 1.0 if i % 2 else float(rng.choice([0.01, 30.0]))
        base = rng.normal(0, scale, 40)
        rows.append((f"r{i}", [[float(v) for v in base + rng.normal(0, scale, 40)] for _ in range(3)]))
        truth.append((f"r{i}", i % 2))
    rows[0] = ("r0", [[0.0] * 40, [float(v) for v in rng.normal(0, 1, 40)], [1.0] * 40])
    out = studies.record_study(spark.createDataFrame(rows, "record string, leads array<array<double>>"), spark.createDataFrame(truth, "record string, label int"), replicas=50, splits=10)
    assert out["features"].where("degenerate").count() == 1
    auc = {r["method"]: r["auc"] for r in out["ablation"].collect()}
    assert auc["u"] > 0.9 and out["delong"].count() == 2 and out["validation"].count() == 3
