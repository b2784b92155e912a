"""Exploratory models as queries. Their figures depend on MLlib's algorithms, so only the
data preparation is held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from relisense.functions.columns import rounded
from relisense.functions.keep import keep
from relisense.operators import labels, learning
from relisense.plans.tables import EXTERNAL, ratings, table, with_sql
from relisense.plans.window_queries import features


def _rated(spark, d):
    return labels.rater_statistics(ratings(spark, d), ["unit"], "valence", EXTERNAL).select("unit", F.col("valence_n_valid").alias("n_valid"), F.col("valence_var").alias("var"), F.col("valence_mean").alias("y"))


def experiment_rows(spark, d):
    rows = learning.experiment_rows(_rated(spark, d).withColumn("score", F.lit(1.0)), "y", "score")
    return rows.select("unit", "n_valid", rounded("w_var", 9).alias("w_var"))


def loso_treatments(spark, d):
    """Five weightings of the training rows, each with 200 trees per held-out subject, compared fold by fold with the plain one."""
    f = keep(features(spark, d).withColumn("score", F.coalesce(F.col("eda_mean") / (F.col("eda_mean") + 10), F.lit(0.5))).withColumn("w_var", 1 / (1 + F.coalesce("hr_std", F.lit(0.0)))).where("hr_mean is not null"))
    t = learning.fold_summary(learning.loso_predictions(f, ["eda_mean", "bvp_mean"], "hr_mean", "score"))
    return t.select("treatment", "metric", "folds", "windows", *[rounded(c).alias(c) for c in ("mean", "std", "pooled", "delta_mean", "wilcoxon_p", "ttest_p")])


def fold_sizes(spark, d):
    f = learning.folds(table(spark, d, "documents").select("doc_id", "source"), "doc_id", group="source")
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("groups"))


def content_model(spark, d):
    """Area under the curve of the quality label, out of fold, from words and one figure."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text", F.col("n_chars").cast("double").alias("chars")), "doc_id").select("doc_id", "text", "chars", F.col("quality").cast("double").alias("label"))
    f = learning.folds(rows, "doc_id")
    p = keep(learning.out_of_fold(f, learning.text_features(numeric=["chars"]), "label", classify=True).select("label", "prediction", "rawPrediction"))
    return spark.createDataFrame([(p.count(), round(learning.area_under_curve(p, "label"), 3))], "n long, auc double")


QUERIES = {
    "experiment_rows": (experiment_rows, with_sql(["rat"], "SELECT unit, count(e) AS n_valid, round(1 / (1 + coalesce(var_samp(e), 0.0)), 9) + 0.0 AS w_var FROM (SELECT unit, CASE WHEN rater LIKE 'R_' THEN valence END AS e FROM rat) GROUP BY unit HAVING count(e) >= 3")),
    "loso_treatments": (loso_treatments, None),
    "fold_sizes": (fold_sizes, None),
    "content_model": (content_model, None),
}
