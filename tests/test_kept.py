"""Tables that many passes read, and quantiles of many columns in few passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relisense.functions.keep import keep
from relisense.functions.quantiles import quantiles
from relisense.plans import trial_queries

SF = "/root/testdata/sf0.001"


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    spark.sparkContext.setJobGroup("other", "other")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_kept_tables_are_columns_on_shared_storage(spark):
    df = spark.createDataFrame([(1, "a", None, [1.5]), (None, "b", float("nan"), None)], "k int, `odd name` string, x double, v array<double>")
    kept = keep(df)
    assert kept.inputFiles() and kept.dtypes == df.dtypes
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert keep(df.limit(0)).count() == 0
    assert keep(df.select("k", F.lit(None).alias("n"))).count() == 2 and keep(df.selectExpr("k", "k as K")).count() == 2


def test_quantiles_of_many_columns_take_no_more_jobs(spark):
    r = np.random.default_rng(4)
    x = [r.normal(0, 1, 20_000), r.integers(0, 3, 20_000).astype(float), r.exponential(1, 20_000).round(2), np.full(20_000, 2.0)]
    df = keep(spark.createDataFrame([tuple(map(float, v)) for v in zip(*x, strict=True)], "a double, b double, c double, d double"))
    one, few = jobs(spark, "one", lambda: quantiles(df, {"a": ("a", 0.3)}, exact_rows=1500))
    all_, many = jobs(spark, "many", lambda: quantiles(df, {c: (c, 0.3) for c in "abcd"}, exact_rows=1500))
    assert many <= few + 4  # adaptive execution may add a job a read; before, each column had its own reads
    assert all_ == {c: pytest.approx(np.percentile(v, 30), abs=1e-12) for c, v in zip("abcd", x, strict=True)} and one["a"] == all_["a"]


def test_variants_read_the_lines_once(spark):
    """Fits and result come from the kept trials, not from the lines again."""
    plan = trial_queries.trial_variants(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "Exchange" not in plan
