"""Per-item figures of trials that are dealt by item once."""

import pytest

from relisense.operators import variance
from relisense.plans import tables, trial_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dispersion_deals_lines_once(spark):
    assert plan(trial_queries.dispersion(spark, SF)).count("Exchange") == 1
    assert plan(tables.trials(spark, SF, "item").groupBy("item").count()).count("Exchange") == 1


def test_dispersion_of_repeated_and_missing_keys(spark):
    """Two rows of one viewer are one viewer, a missing viewer is none, a missing item has no row."""
    rows = [(1, 1, 1.0), (1, 2, 4.0), (1, None, None), (2, 1, 1.0), (2, 1, 3.0), (3, 1, 1.0), (3, None, 3.0), (4, 1, None), (4, 2, 5.0), (None, 1, 1.0), (None, 2, 2.0)]
    df = spark.createDataFrame(rows, "item int, subject int, hr double")
    assert {r["item"]: r["hr"] for r in variance.dispersion(df, ["hr"]).collect()} == {1: pytest.approx(1.5), 4: None}


def test_labels_are_dealt_by_item_once(spark):
    assert plan(trial_queries.label_entropies(spark, SF)).count("Exchange") == 1


def test_medians_of_legs_read_kept_items(spark, monkeypatch):
    """Items are aggregated and kept before their medians are taken, not aggregated again by each reader."""
    seen, made = [], trial_queries.conduct.item_composite
    monkeypatch.setattr(trial_queries.conduct, "item_composite", lambda per, *a: seen.append(plan(per)) or made(per, *a))
    assert "Exchange" not in plan(trial_queries.items(spark, SF)) and "Exchange" not in seen[0]


def test_scores_meet_kept_deviations(spark):
    """The subjects' deviations are a table of known size, not an aggregate inside the join."""
    t = trial_queries.keep(tables.trials(spark, SF))
    assert "Aggregate" not in plan(trial_queries.conduct.trial_coherence(t, ("hr", "hr_base"), ("pupil", "pupil_base")))


def test_partial_correlation_fits_nothing(spark, monkeypatch):
    monkeypatch.setattr(trial_queries.conduct, "trial_scores", lambda *a, **k: pytest.fail("a score was fitted"))
    assert trial_queries.partial_correlation(spark, SF).count() == 1
