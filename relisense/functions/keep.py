"""Keeping an intermediate table on storage that all executors reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def keep(df: DataFrame) -> DataFrame:
    """The table, written once as Parquet in the folder of ``spark.checkpoint.dir`` and read back.

    For tables that several jobs read, such as a feature table under many statistics: a
    reader takes only the columns that it needs, and small tables are known to be small, so
    that joins with them are broadcast. Tables that Parquet can't hold (columns without a
    type, names that differ by case only) are checkpointed. Only where the session names no
    folder (tests on one machine) a temporary one is used.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="relisense-"))
    kinds = df.schema.simpleString()
    if not df.columns or len({c.lower() for c in df.columns}) < len(df.columns) or "void" in kinds or "interval" in kinds:
        return df.checkpoint()
    path = f"{sc.getCheckpointDir().rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
