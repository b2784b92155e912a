"""Exploratory models: leave-one-subject-out treatments and content models.

Forests are grown by ``forest``, boosted trees and regularised models are MLlib's own; their
figures are not meant to equal those of other libraries.
"""

from __future__ import annotations

import math
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, Imputer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relisense.functions.keep import keep
from relisense.operators import forest, models
from relisense.operators.classify import agreement

#: Fixed values of the treatments: least score of the filter, and the shares they keep.
FILTER_MIN, RATERS_MIN = 0.6, 3
TREATMENTS = ("base", "filter", "weight", "variance_weight", "random_drop")
#: Held-out subjects whose models are fitted at a time; a fit on few rows is mostly waiting.
FITS_AT_ONCE = 6


def experiment_rows(features: DataFrame, target: str, score: str, raters: str = "n_valid", variance: str = "var") -> DataFrame:
    """Rows with enough raters, a target and a score; adds ``w_var`` = 1 / (1 + variance)."""
    return features.where((F.col(raters) >= RATERS_MIN) & F.col(target).isNotNull() & F.col(score).isNotNull()).withColumn("w_var", 1 / (1 + F.coalesce(F.col(variance), F.lit(0.0))))


def treated(rows: DataFrame, treatment: str, score: str, seed: int = 42) -> DataFrame:
    """Training rows with their ``weight`` under a treatment.

    random_drop keeps the share that the filter would keep, by hashed row keys, as its control.
    """
    if treatment == "filter":
        return rows.where(F.col(score) > FILTER_MIN).withColumn("weight", F.lit(1.0))
    if treatment == "weight":
        return rows.withColumn("weight", F.col(score))
    if treatment == "variance_weight":
        return rows.withColumn("weight", F.col("w_var"))
    if treatment == "random_drop":
        share = rows.agg(F.avg((F.col(score) > FILTER_MIN).cast("double"))).first()[0] or 0.0
        return rows.where(F.pmod(F.xxhash64("subject", "win", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000).withColumn("weight", F.lit(1.0))
    return rows.withColumn("weight", F.lit(1.0))


def loso_predictions(rows: DataFrame, inputs: list[str], target: str, score: str, treatments: tuple[str, ...] = TREATMENTS, trees: int = 200, depth: int = forest.DEPTH, leaf: int = forest.LEAF, seed: int = 42) -> DataFrame:
    """(treatment, subject, y, x): every row predicted by forests that have not seen its subject.

    All subjects, treatments and trees are grown together (see ``forest``); a treatment only
    changes what is trained on, the held-out rows are always all of a subject's.
    """
    weights = {"base": F.lit(1.0), "filter": (F.col(score) > FILTER_MIN).cast("double"), "weight": F.col(score), "variance_weight": F.col("w_var")}
    drop = {"random_drop": "filter"} if "random_drop" in treatments else {}
    return forest.leave_one_out_forests(rows, inputs, target, {t: w for t, w in weights.items() if t in treatments or drop and t == "filter"}, drop, trees=trees, depth=depth, leaf=leaf, seed=seed).where(F.col("treatment").isin(*treatments))


def boosted_predictions(rows: DataFrame, inputs: list[str], target: str, score: str, treatments: tuple[str, ...] = TREATMENTS, rounds: int = 300, seed: int = 42) -> DataFrame:
    """The same from MLlib's boosted trees, a distributed fit per held-out subject and treatment.

    The fold loop is on the driver, so this is for few subjects; missing inputs are imputed
    by the training median.
    """
    made = VectorAssembler(inputCols=[f"{c}_i" for c in inputs], outputCol="features")
    fill = Imputer(strategy="median", inputCols=inputs, outputCols=[f"{c}_i" for c in inputs])

    def fold(s) -> DataFrame | None:
        fit = GBTRegressor(labelCol=target, weightCol="weight", maxIter=rounds, stepSize=0.05, minInstancesPerNode=20, seed=seed)
        parts = []
        for t in treatments:
            train = treated(rows.where(F.col("subject") != s), t, score, seed)
            if train.isEmpty():
                continue
            p = Pipeline(stages=[fill, made, fit]).fit(train).transform(rows.where(F.col("subject") == s))
            parts.append(p.select(F.lit(t).alias("treatment"), "subject", F.col(target).alias("y"), F.col("prediction").alias("x")))
        return keep(reduce(DataFrame.unionByName, parts)) if parts else None

    subjects = sorted(r["subject"] for r in rows.select("subject").distinct().collect())
    with ThreadPool(FITS_AT_ONCE) as pool:
        done = [p for p in pool.map(inheritable_thread_target(rows.sparkSession)(fold), subjects, chunksize=1) if p is not None]
    return reduce(DataFrame.unionByName, done)


def leave_one_subject_out(rows: DataFrame, inputs: list[str], target: str, score: str, treatments: tuple[str, ...] = TREATMENTS, model: str = "forest", trees: int | None = None, seed: int = 42) -> DataFrame:
    """(treatment, subject, n, ccc, rmse, mae) per held-out subject and treatment: a forest of 200 trees or 300 boosted ones."""
    if model == "forest":
        return agreement(loso_predictions(rows, inputs, target, score, treatments, trees or 200, seed=seed), ["treatment", "subject"])
    return agreement(boosted_predictions(rows, inputs, target, score, treatments, trees or 300, seed=seed), ["treatment", "subject"])


def fold_summary(predictions: DataFrame, base: str = "base") -> DataFrame:
    """(treatment, metric, folds, windows, mean, std, pooled, delta_mean, wilcoxon_p, ttest_p) from out-of-fold predictions.

    mean and std are over folds, pooled is the figure over all rows; the differences of base
    and treatment per fold are tested by signed ranks and by a paired t. Base itself has none.
    """
    metrics = ["ccc", "rmse", "mae"]
    long = lambda df, keys: df.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("_m")).select(*keys, "n", "_m.metric", "_m.v")
    folds = keep(long(agreement(predictions, ["treatment", "subject"]), ["treatment", "subject"]))
    whole = long(agreement(predictions, ["treatment"]), ["treatment"]).select("treatment", "metric", F.col("n").alias("windows"), F.col("v").alias("pooled"))
    own = folds.where(F.col("treatment") == base).select("subject", "metric", F.col("v").alias("_b"))
    d = keep(folds.where(F.col("treatment") != base).join(own, ["subject", "metric"]).withColumn("d", F.col("_b") - F.col("v")))
    keys = ["treatment", "metric"]
    ranked = models.with_wilcoxon_p(models.signed_rank(d, keys, "d")).select(*keys, F.col("mean_diff").alias("delta_mean"), F.col("p").alias("wilcoxon_p"))
    paired = models.with_t_p(models.paired_t(d, keys, "d"), "t", F.col("n") - 1).select(*keys, F.col("p").alias("ttest_p"))
    per = folds.groupBy(*keys).agg(F.count("v").alias("folds"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return per.join(whole, keys).join(ranked, keys, "left").join(paired, keys, "left").select(*keys, "folds", "windows", "mean", "std", "pooled", "delta_mean", "wilcoxon_p", "ttest_p")


def term_counts(rows: DataFrame, n: int, least_docs: float, terms: str = "_terms") -> DataFrame:
    """(term, all_0.., docs_0..): of each term its number and its documents without each of n folds.

    One pass for all folds: terms are counted per fold, and a fold is subtracted from the whole.
    Terms of fewer than least_docs documents without any fold have no row.
    """
    each = f"explode(concat(transform({terms}, t -> struct(t as term, 1L as a, 0L as d)), transform(array_distinct({terms}), t -> struct(t as term, 0L as a, 1L as d)))) as _t"
    own = rows.selectExpr("fold", each).groupBy("_t.term").agg(*[F.sum(F.when(F.col("fold") != k, F.col(f"_t.{c}")).otherwise(0)).alias(f"{name}_{k}") for k in range(n) for c, name in (("a", "all"), ("d", "docs"))])
    return own.where(reduce(Column.__or__, [F.col(f"docs_{k}") >= least_docs for k in range(n)]))


def terms_once(df: DataFrame, features: Pipeline, n: int) -> tuple[DataFrame, list[Pipeline]]:
    """Rows with term vectors, made once for all folds, and of each fold what is left of the pipeline.

    A fold's model is to know the most frequent terms of the other folds and their document
    frequencies there. Texts are cut and counted once; the vectors hold the terms of any fold,
    and a fold's weight is 0 for those that it doesn't know, so that they add nothing to its
    lengths and get no coefficient.
    """
    stages = features.getStages()
    cv = next(i for i, s in enumerate(stages) if isinstance(s, CountVectorizer))
    idf = next(i for i, s in enumerate(stages) if isinstance(s, IDF))
    counter, least = stages[cv], stages[cv].getMinDF()
    terms = counter.getInputCol()
    rows = keep(PipelineModel(stages[:cv]).transform(df).select(*df.columns, terms))
    counts = keep(term_counts(rows, n, least, terms))
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    known = []
    for k in range(n):
        best = counts.where(F.col(f"docs_{k}") >= least).orderBy(F.col(f"all_{k}").desc(), "term").limit(counter.getVocabSize())
        known.append({r["term"]: r["docs"] for r in best.select("term", F.col(f"docs_{k}").alias("docs")).collect()})  # a vocabulary
    words = sorted(set().union(*known)) or [""]
    vectors = CountVectorizerModel.from_vocabulary(words, inputCol=terms, outputCol=counter.getOutputCol()).transform(rows).drop(terms)
    vectors = keep(PipelineModel(stages[cv + 1 : idf]).transform(vectors))
    left = []
    for k, docs in enumerate(known):
        trained = sum(sizes.values()) - sizes.get(k, 0)
        weights = Vectors.dense([math.log((trained + 1) / (docs[w] + 1)) if w in docs else 0.0 for w in words])
        left.append(Pipeline(stages=[ElementwiseProduct(inputCol=stages[idf].getInputCol(), outputCol=stages[idf].getOutputCol(), scalingVec=weights), *stages[idf + 1 :]]))
    return vectors, left


class Sublinear(Transformer):
    """Term counts n as 1 + ln(n)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        import numpy as np

        damp = F.udf(lambda v: SparseVector(v.size, v.indices, 1 + np.log(v.values)), VectorUDT())
        return df.withColumn("_tf", damp("_tf"))


def text_features(text: str = "text", terms: int = 5000, least_docs: int = 2, numeric: list[str] | None = None) -> Pipeline:
    """TF-IDF of words and word pairs with sublinear counts, and standardised numeric columns."""
    both = SQLTransformer(statement="SELECT *, concat(_w, _p) AS _terms FROM __THIS__")
    whole = SQLTransformer(statement=f"SELECT *, coalesce(`{text}`, '') AS _whole FROM __THIS__")
    stages = [whole, RegexTokenizer(inputCol="_whole", outputCol="_w", pattern=r"\W+", minTokenLength=2), NGram(inputCol="_w", outputCol="_p"), both, CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=terms, minDF=least_docs), Sublinear(), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_text")]
    parts = ["_text"]
    if numeric:
        stages += [Imputer(strategy="median", inputCols=numeric, outputCols=[f"_{c}" for c in numeric]), VectorAssembler(inputCols=[f"_{c}" for c in numeric], outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
        parts.append("_scaled")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def folds(df: DataFrame, key: str, n: int = 5, seed: int = 42, group: str | None = None) -> DataFrame:
    """Adds ``fold``: by the hashed key, or whole groups by the hashed group."""
    return df.withColumn("fold", F.pmod(F.xxhash64(group or key, F.lit(seed)), F.lit(n)).cast("int"))


def out_of_fold(df: DataFrame, features: Pipeline, target: str, classify: bool = False, n: int = 5) -> DataFrame:
    """Rows of df with ``prediction``, each made by a model that did not see its fold.

    Pipelines that count terms and weigh them (CountVectorizer and IDF) share the counting.
    """
    kinds = [type(s) for s in features.getStages()]
    df, own = terms_once(df, features, n) if CountVectorizer in kinds and IDF in kinds else (df, [features] * n)
    out = None
    for k in range(n):
        train, test = df.where(F.col("fold") != k), df.where(F.col("fold") == k)
        if classify:
            share = train.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.5
            train = train.withColumn("_w8", F.when(F.col(target) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
            model = LogisticRegression(labelCol=target, weightCol="_w8", regParam=1e-3)
        else:
            model = LinearRegression(labelCol=target, regParam=1e-3, elasticNetParam=0.0)
        p = Pipeline(stages=[own[k], model]).fit(train).transform(test)
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def area_under_curve(predictions: DataFrame, target: str) -> float:
    return BinaryClassificationEvaluator(labelCol=target).evaluate(predictions)


def permuted(df: DataFrame, target: str, seed: int = 42) -> DataFrame:
    """The target dealt out anew among the rows, as a control: ranked by one hash, given by another."""
    from relisense.operators.ranks import average_rank

    one = df.withColumn("_one", F.lit(1)).withColumn("_h", F.xxhash64(F.lit(seed), *[c for c in df.columns if c != target]))
    places = average_rank(one, ["_one"], "_h", "_k")
    values = average_rank(one.select("_one", F.col(target).alias("_t"), F.xxhash64(F.lit(seed + 1), "_h").alias("_g")), ["_one"], "_g", "_k")
    return places.drop(target, "_h").join(values.select("_k", F.col("_t").alias(target)), "_k", "left").drop("_one", "_k")
