"""Fits of large tables from counts of their values."""

import pytest
from pyspark.sql import functions as F

from relisense.functions import quantiles as module
from relisense.operators.scores import Monotone, UScore

ROWS = [(float(i % 7), None if i % 3 else float(i * i % 901), 2.0, None, -0.0 if i % 2 else 0.0) for i in range(1500)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "a double, b double, c double, d double, e double")


def test_fits_from_counts_equal_those_from_rows(df, monkeypatch):
    columns = {k: k for k in "abcde"} | {"f": F.col("a") * 3}
    fits = lambda: (UScore.fit(df, columns), UScore.fit(df, columns, cut=False), Monotone.fit(df, {k: (c, -1) for k, c in columns.items()}))
    plain = fits()
    monkeypatch.setattr(module, "EXACT_ROWS", 100)
    assert fits() == plain
    monkeypatch.setattr(module, "FEW_VALUES", 20)  # b has more values and stays with the table
    assert [sorted(cols) for _, cols, _ in module.by_value(df, {k: F.col(k) for k in "ab"}, 1500)] == [["b"], ["a"]]
    assert fits() == plain


def test_all_quantiles_read_the_counts(spark, df, monkeypatch):
    monkeypatch.setattr(module, "EXACT_ROWS", 100)
    (table, cols, weight), = module.by_value(df, {"a": F.col("a")}, 1500)
    assert table.count() == 7 and table.agg(F.sum(weight)).first()[0] == 1500
    assert module.quantiles(table, {"q": (cols["a"], 0.25)}, weight=weight)["q"] == df.agg(F.percentile("a", F.lit(0.25))).first()[0]
