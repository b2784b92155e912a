"""Rows dealt in parts that don't grow with the table."""

import pytest

from relisense.functions import spread as module
from relisense.operators import labels, variance
from relisense.operators.variance import one_way_icc, variance_decomposition
from relisense.plans import join_queries, tables, trial_queries

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "PART_ROWS", 100)
    df = spark.range(2050).selectExpr("id % 7 as k", "id")
    out = module.spread(df, "k")
    assert out.rdd.getNumPartitions() == 21 and module.spread(df, "k", rows=1).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert exchanges(out.groupBy("k", "id").count()).count("Exchange") == 1


@pytest.mark.parametrize("made", [lambda s: tables.trials(s, SF), lambda s: trial_queries._few_viewers(s, SF), lambda s: trial_queries._two_sources(s, SF)[0], lambda s: join_queries._heart(s, SF)])
def test_trials_are_made_in_small_parts(spark, monkeypatch, made):
    monkeypatch.setattr(module, "PART_ROWS", 500)
    assert "REPARTITION_BY_NUM" in exchanges(made(spark)) and made(spark).rdd.getNumPartitions() >= 6


def test_viewer_pairs_deal_nothing_by_subject(spark, monkeypatch):
    """Only pairs meet the subjects' means; a third viewer without a name is a viewer, as in the SQL."""
    rows = [(i, s, float((i * 7 + k * 3) % 11), 1.0 * i) for i in range(30) for k, s in enumerate(("A", "B"))] + [(i, None, 1.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "item long, subject string, hr double, rt double")
    got = {r["metric"]: r for r in variance.viewer_pairs(df, ["hr", "rt"]).collect()}
    assert {(m, r["a"], r["b"], r["n"]) for m, r in got.items()} == {("hr", "A", "B", 25), ("rt", "A", "B", 25)}
    assert got["rt"]["r"] == pytest.approx(1.0)


def test_overlap_of_repeated_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(module, "PART_ROWS", 3)
    a = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 1), (3, 2)], "item int, subject int")
    b = spark.createDataFrame([(1, 1), (1, 2), (3, 2), (3, 2), (4, 1), (None, 1)], "item int, subject int")
    row = labels.source_overlap(a, b, spark.createDataFrame([(1,), (1,), (9,)], "item int")).first()
    assert [row[k] for k in ("pairs_a", "pairs_b", "pairs_both", "items_a", "items_b", "items_both", "items_labelled", "items_unlabelled")] == [4, 5, 3, 4, 4, 3, 1, 2]


def test_decomposition_equals_one_icc_at_a_time(spark):
    """Sums about the mean give the figures of the plain analysis; trials without a subject are a group."""
    rows = [(i % 9, None if i % 13 == 0 else i % 5, 1e6 + (i * 37 % 101) / 7 + i % 9, None if i % 4 == 0 else float(i * 53 % 17)) for i in range(400)]
    df = spark.createDataFrame(rows, "item int, subject int, a double, b double")
    got = {r["metric"]: r for r in variance_decomposition(df, ["a", "b"]).collect()}
    for m in "ab":
        one = lambda g, v, d=df: one_way_icc(d.selectExpr("1 as one", g, f"{v} as v"), ["one"], g, "v").first()
        centred = df.selectExpr("*", f"{m} - avg({m}) over (partition by subject) as c")
        assert got[m]["icc_subject"] == pytest.approx(one("subject", m)["icc"], abs=1e-9)
        assert got[m]["icc_item"] == pytest.approx(one("item", m)["icc"], abs=1e-9) and got[m]["rows"] == one("item", m)["n"]
        assert got[m]["icc_item_centred"] == pytest.approx(one("item", "c", centred)["icc"], abs=1e-9)
