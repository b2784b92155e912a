"""Folders that the driver and every executor can reach."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a folder of our own is
    made and set, so that ``DataFrame.checkpoint()`` works there as well.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="relisense-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch that goes to a Python task, about (a longer row is a batch of its own). By
#: default it is 64 MB, which the JVM and its Python worker each hold more than once.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def small_batches(spark: SparkSession) -> None:
    """Has the session send texts to Python tasks in batches of BATCH_BYTES, unless it has a limit of its own.

    Results don't depend on it; the setting stays, as it is read when a query is run.
    """
    key, most = BATCH_BYTES
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)


def in_parts(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """The batches of a task in smaller parts, so that what is made of them stays small; between
    batches and at the end unused memory goes back to the system, as workers live on for later stages."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.iloc[i : i + rows]
        give_back()


def give_back() -> None:
    """Returns memory that Arrow and the C library keep for themselves to the system, where they can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


#: A key is hot if it holds a row in so many, or more.
HOT_ONE_IN = 1000
#: So many narrow rows may meet in one task, whatever their keys; below, a plain join does.
PLAIN_ROWS = 1_000_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with table, which has one row per key and how many of the rows hold it.

    Keys that hold one in HOT_ONE_IN of the rows or more are at most HOT_ONE_IN keys, so they
    are broadcast; the others meet in a shuffle, in which none of them can fill a task.
    how: inner or left. ``weight`` doesn't come along. Both tables are read more than once.
    total: the number of rows, where it is known.
    """
    total = rows.count() if total is None else total
    if total <= PLAIN_ROWS:
        return rows.join(table.drop(weight), key, how)
    hot = table.where(F.col(weight) * HOT_ONE_IN >= total).drop(weight)
    cold = table.where(F.col(weight) * HOT_ONE_IN < total).drop(weight)
    some = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(some, key, "left_anti").join(cold, key, how))
