"""Reproducible shuffle and sharding by a Feistel permutation of row numbers.

Rows are numbered 0..N-1 in the order (id, size, crc), a permutation of that range is
applied, and the position gives the shard (position modulo shard count) and the slot in
it (position divided by shard count). Both are computable from the row number alone, and
the permutation can be inverted, so any slot of any shard can be located without a search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relisense.llm.shared import shared_root

#: Bytes counted for a row beside its text.
ROW_OVERHEAD = 16
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def _round_keys(seed: int, rounds: int) -> list[np.uint64]:
    return [np.uint64((seed * 0x2545F4914F6CDD1D + (r + 1) * _GOLD) & 0xFFFFFFFFFFFFFFFF) for r in range(rounds)]


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + key) * _M1
        x ^= x >> np.uint64(29)
        x *= _M2
        return x ^ (x >> np.uint64(32))


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _pass(x: np.ndarray, n: int, keys: list[np.uint64], back: bool) -> np.ndarray:
    """One pass through the network on the smallest power of two that holds n."""
    a, b = _halves(n)
    lo, hi = np.uint64((1 << a) - 1), np.uint64((1 << b) - 1)
    left, right = x >> np.uint64(b), x & hi  # left has a bits, right has b bits
    order = list(enumerate(keys))
    for r, key in reversed(order) if back else order:
        if r % 2 == 0:
            left = left ^ (_mix(right, key) & lo)
        else:
            right = right ^ (_mix(left, key) & hi)
    return (left << np.uint64(b)) | right


def permute(rows: np.ndarray, n: int, seed: int = 0, rounds: int = 6, back: bool = False) -> np.ndarray:
    """Permutes numbers in 0..n-1; with back=True, the inverse.

    The network permutes a power of two below 2n (or 4 for tiny n); whatever falls outside
    the range is walked on along its cycle until it is inside again, which keeps the map a
    bijection on 0..n-1.
    """
    x = _pass(np.asarray(rows, dtype=np.uint64), n, keys := _round_keys(seed, rounds), back)
    while (out := x >= np.uint64(n)).any():
        x[out] = _pass(x[out], n, keys, back)
    return x.astype(np.int64)


def row_of(shard: int, slot: int, n: int, n_shards: int = 40, seed: int = 0) -> int:
    """The row number that lies in a slot of a shard."""
    return int(permute(np.array([slot * n_shards + shard]), n, seed, back=True)[0])


def shard_rows(docs: DataFrame, n_shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, row_no, law, shard, slot, grown_shard.

    Law ``rows``: shard sizes differ by one row at most, slots are gapless from 0. Null
    text counts as empty; null ids sort first; repeated rows get numbers of their own;
    other columns, whatever their names, are not read. An empty table gives no rows.

    Only the id, the size and the checksum are sorted (one range shuffle); the sorted
    rows go to the checkpoint folder so that numbering them rests on one fixed layout,
    also after an executor is lost. What reaches the driver is one count per partition.
    """
    spark = docs.sparkSession
    shared_root(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias(id_col), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = [F.col(id_col).asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    laid = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = laid.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint()
    counts = sorted((r["_part"], r["count"]) for r in laid.groupBy("_part").count().collect())  # one row per partition
    starts, n = [], 0
    for part, count in counts:
        starts.append((part, n))
        n += count

    @F.pandas_udf("long")
    def position(row_no: pd.Series) -> pd.Series:
        return pd.Series(permute(row_no.to_numpy(), n, seed))

    first = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))  # as many rows as partitions
    placed = laid.join(first, "_part").withColumn("row_no", F.col("_start") + F.col("_nth")).withColumn("_at", position("row_no"))
    return placed.select(
        id_col, "size", "text_crc32", "row_no", F.lit("rows").alias("law"), (F.col("_at") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("_at") / F.lit(n_shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_rows(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_no")
