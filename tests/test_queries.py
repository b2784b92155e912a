"""A spread of the registered queries against their SQL, and the entry module."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from relisense.plans import registry

SF = "/root/testdata/sf0.001"
CHOSEN = ["window_agg", "window_table", "rolling_std", "coherence_sweep", "period_assignment", "stability", "trial_scores", "item_scores", "item_classes", "multiple_testing", "variance_components", "label_entropies", "rater_statistics", "source_overlap", "low_quality", "kurtosis_sqi", "lead_correlation", "roc_points", "signed_rank", "fitted_elsewhere", "mixed_model", "leverage", "composite_family", "grid_alignment", "trial_join", "item_join", "paired_comparison", "partial_within"]


def rows(df):
    def cell(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, db, name):
    f, sql = registry.ALL[name]
    ours, theirs = f(spark, SF).toPandas(), db.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())
