"""Tumbling windows over a stream, scored by models that were fitted in batch.

Population scores need the whole population, so they can't be fitted on a stream; a fitted
model is a plain expression and can be applied to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relisense.operators.scores import UScore


def live_windows(stream: DataFrame, time: str = "ts", width: str = "5 seconds", late: str = "30 seconds") -> DataFrame:
    """(subject, channel, start, mean, std, n_samples) in append mode; rows later than ``late`` are lost.

    Works on a batch table as well.
    """
    s = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    agg = s.groupBy("subject", "channel", F.window("_at", width).alias("w")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n_samples"))
    return agg.select("subject", "channel", F.col("w.start").alias("start"), "mean", "std", "n_samples")


def live_scores(windows: DataFrame, models: dict[str, UScore]) -> DataFrame:
    """Adds ``u``: each channel's deviation scored by its fitted model; NULL for other channels."""
    score = F.lit(None).cast("double")
    for channel, m in models.items():
        score = F.when(F.col("channel") == channel, m.score("std")).otherwise(score)
    return windows.withColumn("u", score)
