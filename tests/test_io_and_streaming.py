import json

import numpy as np
import pytest

from relisense.operators import labels, waveform, windows
from relisense.operators.scores import UScore
from relisense.sources import readers, writers
from relisense.streaming.live import live_scores, live_windows


def test_signals_of_all_subjects(spark, tmp_path):
    (tmp_path / "1").mkdir()
    (tmp_path / "2").mkdir()
    (tmp_path / "1" / "E4_HR.csv").write_text("timestamp,value\n0,1\n1,\n2,3\n")
    (tmp_path / "1" / "E4_ACC.csv").write_text("timestamp,x,y,z\n0,1,2,3\n1,2,3,4\n")
    (tmp_path / "2" / "E4_HR.csv").write_text("timestamp,bpm\n5,9\n")
    s = readers.read_signals(spark, str(tmp_path / "*" / "E4_*.csv"), "E4")
    rows = s.collect()
    assert len(rows) == 10 and {r["channel"] for r in rows} == {"HR", "ACC"}
    assert s.where("value is null").count() == 1 and s.where("subject = '2'").first()["value"] == 9.0
    acc = windows.window_multiaxis(s.where("channel = 'ACC'")).first()
    assert acc["n_samples"] == 2 and acc["std"] == pytest.approx(np.std([1, 2], ddof=1))


def test_annotations_and_tables(spark, tmp_path):
    (tmp_path / "P3.self.csv").write_text("seconds,arousal,valence\n5,1,2\n10,3,4\n")
    (tmp_path / "P3.R1.csv").write_text("when,valence\n1000,5\n")
    rows = readers.read_annotations(spark, str(tmp_path / "P*.csv")).collect()
    assert {(r["subject"], r["rater"], r["seconds"], r["absolute"]) for r in rows} == {("3", "self", 5.0, None), ("3", "self", 10.0, None), ("3", "R1", None, 1000.0)}
    (tmp_path / "q.csv").write_text("hr,eda\n0.9,n/a\n4007 (0.994),1\n")
    assert [r["pid"] for r in readers.read_ordinal_csv(spark, str(tmp_path / "q.csv")).collect()] == [1, 2]


def test_label_map_corpus_and_lists(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"7": {"labels_task2_1": ["YES", "NO", "YES"], "labels_task2_2": [], "labels_task2_3": [["a", "b"], ["a"]]}, "8": {"labels_task2_1": []}}))
    m = readers.read_label_map(spark, str(tmp_path / "l.json"))
    assert m.count() == 2 and m.where("item = '8'").first()["task3"] is None
    e = labels.label_entropy(labels.flattened(m, "item", "task3"), "item").first()
    assert e["hard"] == "a" and e["entropy"] == pytest.approx(-(2 / 3 * np.log(2 / 3) + 1 / 3 * np.log(1 / 3)))
    (tmp_path / "c.json").write_text(json.dumps([{"id": 1, "text": "a", "img_0": 1.5}, {"id": 1, "text": "b", "img_0": 2.5}]))
    c = readers.read_corpus(spark, str(tmp_path / "c.json"), "id").collect()
    assert [(r["item"], r["text"], r["img_0"]) for r in c] == [("1", "a", 1.5)]
    for name, text in (("r", "a\nb\n\nc\n"), ("ok", "a\nb\n"), ("bad", "b \n")):
        (tmp_path / name).write_text(text)
    g = {r["record"]: r["label"] for r in readers.read_ground_truth(spark, *(str(tmp_path / x) for x in ("r", "ok", "bad"))).collect()}
    assert g == {"a": 1, "b": 0, "c": None}


def test_waveforms(spark, tmp_path):
    samples = np.array([[100, -200], [200, -400], [300, 50], [100, 0]], dtype="<i2")
    (tmp_path / "a01.dat").write_bytes(samples.tobytes())
    r = readers.read_waveforms(spark, str(tmp_path / "*.dat"), 2, 500.0)
    assert r.first()["record"] == "a01" and r.first()["leads"][0] == [0.5, 1.0, 1.5, 0.5]
    s = waveform.long_leads(r)
    assert waveform.std_signal(s).first()["sigma"] == pytest.approx(np.mean(np.std(samples / 200, axis=0)))
    assert waveform.std_window(s, 5).first()["sigma"] == 0.0
    one = waveform.lead_correlation(s.where("lead = 0")).first()
    assert one["corr"] is None and not one["degenerate"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 0.5, None)], "name string, x double, y double")
    writers.write_table(df, str(tmp_path / "t"), "csv")
    assert spark.read.csv(str(tmp_path / "t"), header=True).columns == ["name", "x", "y"]
    assert r"a\_b & 0.5000 & --" in writers.latex_table(df, "c")
    assert {r["column"]: r["nulls"] for r in readers.inspect(df).collect()} == {"name": 0, "x": 0, "y": 1}


def test_live_windows_equal_batch(spark, tmp_path):
    rows = [(1, "hr", f"2024-01-01 00:00:{s:02d}", float(s % 7)) for s in range(0, 60)]
    spark.createDataFrame(rows, "subject int, channel string, ts string, value double").selectExpr("subject", "channel", "cast(ts as timestamp) ts", "value").write.parquet(str(tmp_path / "in"))
    batch = live_windows(spark.read.parquet(str(tmp_path / "in")))
    model = {"hr": UScore.fit(batch, ["std"])["std"]}
    stream = spark.readStream.schema("subject int, channel string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = live_scores(live_windows(stream), model).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["start"]: r["u"] for r in spark.table("live").collect()}
    want = {r["start"]: r["u"] for r in live_scores(batch, model).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_periods_and_population(spark):
    w = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 0)], "subject int, win long")
    times = spark.createDataFrame([(1, 0.0, 10.0, 20.0)], "subject int, init double, start double, end double")
    out = {(r["subject"], r["win"]): (r["period"], r["win_in_period"]) for r in windows.assign_period(w, times).collect()}
    assert out[(1, 5)] == ("pre", 2) and out[(1, 2)] == ("debate", 0) and out[(2, 0)] == ("debate", 0)
    cells = spark.createDataFrame([(1, "hr", 0, 1.0, None, 1), (1, "aux", 9, 1.0, None, 1), (1, "aux", 0, 5.0, None, 2)], "subject int, channel string, win long, mean double, std double, n_samples long")
    t = windows.window_table(cells, ["hr", "eda"], ["aux"]).collect()
    assert len(t) == 1 and t[0]["aux_mean"] == 5.0 and t[0]["eda_n_samples"] is None


def test_waveform_headers(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = rng.integers(-2000, 2000, (51, 3))
    a[5, 1] = -2048
    u = (a.ravel() & 0xFFF).tolist() + [0]
    packed = bytes(x for lo, hi in zip(u[::2], u[1::2]) for x in (lo & 0xFF, lo >> 8 | hi >> 8 << 4, hi & 0xFF))
    (tmp_path / "r1.dat").write_bytes(packed[:-1])  # an odd number of samples
    (tmp_path / "r1.hea").write_text("# a comment\nr1 3 360 51\nr1.dat 212 100(10)/mV 12 5 0 0 0 I\nr1.dat 212 0 12 7 0 0 0 lead II\nr1.dat 212\n")
    b, c = rng.integers(-30000, 30000, (40, 2)).astype("<i2"), rng.integers(-9, 9, (40, 1)).astype("<i2")
    b[3, 0] = -32768
    (tmp_path / "r2a.dat").write_bytes(b.tobytes())
    (tmp_path / "r2b.dat").write_bytes(c.tobytes())
    (tmp_path / "r2.hea").write_text("r2/1 3 500 40\nr2a.dat 16 50/uV 16 0 0 0 0 x\nr2b.dat 16 2(-4) 16 0 0 0 0 y\nr2a.dat 16 200 16 3 0 0 0 z\n")
    got = {r["record"]: r for r in readers.read_records(spark, f"file://{tmp_path}/*.hea", f"file://{tmp_path}/*.dat").collect()}
    assert got["r1"]["fs"] == 360 and got["r1"]["names"] == ["I", "lead II", ""]
    want = np.where(a == -2048, np.nan, a.astype(float))
    for k, (base, gain) in enumerate(((10, 100), (7, 200), (0, 200))):
        np.testing.assert_allclose(np.array(got["r1"]["leads"][k], dtype=float), (want[:, k] - base) / gain)
    np.testing.assert_allclose(np.array(got["r2"]["leads"][0], dtype=float), np.where(b[:, 0] == -32768, np.nan, b[:, 0] / 50))
    np.testing.assert_allclose(got["r2"]["leads"][1], (c[:, 0] + 4.0) / 2)
    np.testing.assert_allclose(got["r2"]["leads"][2], (b[:, 1] - 3.0) / 200)
    with pytest.raises(ValueError, match="signal line"):
        readers.parse_header("r 1 100 5\nf.dat 80 200", "")
