"""Content models: terms of all folds are cut and counted once."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from relisense.functions.keep import keep
from relisense.operators import learning


def table(spark):
    words = ["alpha", "beta", "gamma", "delta", "x", "omega", "sigma"]
    rows = [(i, " ".join(words[(i * k + k * k) % 7] for k in range(1, 4 + i % 5)), float(i % 3), float(i % 2)) for i in range(60)] + [(60, None, 1.0, 0.0), (61, "", None, 1.0)]
    return learning.folds(spark.createDataFrame(rows, "doc_id long, text string, chars double, label double"), "doc_id", 3)


def test_a_folds_terms_are_those_of_the_other_folds(spark):
    rows = keep(PipelineModel(learning.text_features().getStages()[:4]).transform(table(spark)).select("fold", "_terms"))
    counts = {r["term"]: r for r in learning.term_counts(rows, 3, 2).collect()}
    for k in range(3):
        model = CountVectorizer(inputCol="_terms", outputCol="_tf", minDF=2).fit(rows.where(F.col("fold") != k))
        assert {t for t, r in counts.items() if r[f"docs_{k}"] >= 2} == set(model.vocabulary)
        order = [counts[t][f"all_{k}"] for t in model.vocabulary]
        assert order == sorted(order, reverse=True)


def test_predictions_equal_a_pipeline_fitted_per_fold(spark):
    """Texts are cut once for all folds; rows without text are predicted too."""
    df, features = table(spark), learning.text_features(numeric=["chars"])
    vectors, own = learning.terms_once(df, features, 3)
    assert vectors.count() == df.count() and len(own) == 3 and not any(isinstance(s, CountVectorizer) for p in own for s in p.getStages())
    got = {r["doc_id"]: r["rawPrediction"][1] for r in learning.out_of_fold(df, features, "label", classify=True, n=3).collect()}
    assert sorted(got) == list(range(62))
    for k in range(3):
        train = df.where(F.col("fold") != k)
        share = train.agg(F.avg("label")).first()[0]
        train = train.withColumn("_w8", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
        plain = Pipeline(stages=[features, LogisticRegression(labelCol="label", weightCol="_w8", regParam=1e-3)]).fit(train)
        for r in plain.transform(df.where(F.col("fold") == k)).collect():
            assert got[r["doc_id"]] == pytest.approx(r["rawPrediction"][1], abs=1e-2)
