"""The learning queries run over all subjects, treatments and defaults of their operators."""

import inspect

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizer

from relisense.operators import learning
from relisense.plans import learning_queries

SF = "/root/testdata/sf0.001"


class Caught(Exception):
    pass


def caught(monkeypatch, name, run):
    """The arguments, with defaults, that the query hands to an operator (which isn't run)."""
    signature, seen = inspect.signature(getattr(learning, name)), {}

    def stand_in(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Caught

    monkeypatch.setattr(learning, name, stand_in)
    with pytest.raises(Caught):
        run()
    return seen


def test_loso_query_takes_everything(spark, monkeypatch):
    seen = caught(monkeypatch, "loso_predictions", lambda: learning_queries.loso_treatments(spark, SF))
    rated = learning_queries.features(spark, SF).where("hr_mean is not null")
    assert seen["rows"].select("subject").distinct().count() == rated.select("subject").distinct().count() > 3
    assert seen["rows"].count() == rated.count()
    assert seen["treatments"] == learning.TREATMENTS and seen["trees"] == 200


def test_content_query_takes_defaults(spark, monkeypatch):
    seen = caught(monkeypatch, "out_of_fold", lambda: learning_queries.content_model(spark, SF))
    counts = [s for s in seen["features"].getStages() if isinstance(s, CountVectorizer)]
    assert counts[0].getVocabSize() == 5000 and seen["n"] == 5
    assert {r["fold"] for r in seen["df"].select("fold").distinct().collect()} == set(range(5))


def test_loso_small(spark):
    """Every subject is held out under every treatment; few trees keep it cheap."""
    rng = np.random.default_rng(4)
    rows = [(s, w, float(x), float(2 * x + rng.normal(0, 0.1)), float(rng.random()), 1.0 / (1 + w % 3)) for s in range(4) for w, x in enumerate(rng.normal(0, 1, 30))]
    rows = spark.createDataFrame(rows, "subject int, win int, a double, y double, score double, w_var double")
    out = learning.leave_one_subject_out(rows, ["a"], "y", "score", trees=3).collect()
    assert {(r["treatment"], r["subject"], r["n"]) for r in out} == {(t, s, 30) for t in learning.TREATMENTS for s in range(4)}
    assert all(r["ccc"] > 0.5 for r in out)
