"""Connected components of an edge table, in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relisense.llm.shared import PLAIN_ROWS, join_hot, shared_root

#: Rounds at most; the method needs about the logarithm of the longest path.
ROUNDS_MAX = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id of an edge.

    Alternating large-star and small-star rounds: each node links its larger, then its
    smaller neighbours to the least one it knows, until no edge changes. Minima are found
    by partial aggregation and reach a hub's neighbours by a broadcast of the few hubs, so
    these never meet in one group or task; each round ends in a checkpoint, so a lost executor costs one round. Nulls and loops are left out.
    """
    shared_root(edges.sparkSession)
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state, n = None, e.count()
    for _ in range(ROUNDS_MAX):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        held = DataFrame.checkpoint if 2 * n > PLAIN_ROWS else lambda df: df  # what a split join reads twice
        least = held(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("larger")))
        e = held(join_hot(both.where("v > u"), least, "u", "larger", total=2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = held(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges")))
        hung = join_hot(e, least, "u", "edges", total=n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        new = e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))), F.lit(0))).first()
        if new == state:
            break
        state, n = new, new[0]
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS_MAX} rounds")
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
