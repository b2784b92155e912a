"""All registered queries of the studies, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relisense.plans import family_queries, join_queries, learning_queries, record_queries, trial_queries, window_queries

ALL = window_queries.QUERIES | family_queries.QUERIES | join_queries.QUERIES | trial_queries.QUERIES | record_queries.QUERIES | learning_queries.QUERIES
FLAGSHIP = "window_scores"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in ALL.items() if s}
