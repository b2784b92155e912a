"""Annotators' labels: entropies, soft and hard labels, rater statistics, coverage of viewers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relisense.functions.columns import div
from relisense.functions.keep import keep
from relisense.functions.spread import spread


def label_entropy(labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, n, entropy, hard): natural-log Shannon entropy of the labels and their mode, of
    equally frequent ones the least; from one row per label."""
    counts = labels.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).cast("double").alias("c"))
    t = counts.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), F.max("c").alias("m"), F.collect_list(F.struct("c", F.col(label).alias("l"))).alias("all"))
    hard = F.array_min(F.transform(F.filter("all", lambda x: x["c"] == F.col("m")), lambda x: x["l"]))
    return t.select(key, F.col("n").cast("long").alias("n"), (F.log("n") - F.col("s") / F.col("n")).alias("entropy"), hard.alias("hard"))


def binary_entropy(labels: DataFrame, key: str, label: str = "label", yes: str = "YES", no: str = "NO") -> DataFrame:
    """(key, n, p_yes, entropy, hard): shares over all labels, so other values shrink both."""
    t = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == yes).cast("double")).alias("p_yes"), F.avg((F.col(label) == no).cast("double")).alias("p_no"))
    part = lambda p: F.when(F.col(p) > 0, -F.col(p) * F.log(p)).otherwise(0.0)
    return t.select(key, "n", "p_yes", (part("p_yes") + part("p_no")).alias("entropy"), F.when(F.col("p_yes") >= 0.5, yes).otherwise(no).alias("hard"))


def flattened(nested: DataFrame, key: str, lists: str) -> DataFrame:
    """(key, label) from a column of lists of lists."""
    return nested.select(key, F.explode(F.flatten(lists)).alias("label"))


def rater_statistics(raters: DataFrame, unit: list[str], value: str, external: list[str], own: str = "self", partner: str = "partner", with_range: bool = True) -> DataFrame:
    """(unit, mean, var[, range], n_valid, self_partner_diff, self_external_diff) from one row per rater."""
    ext = F.when(F.col("rater").isin(external), F.col(value))
    one = lambda r: F.avg(F.when(F.col("rater") == r, F.col(value)))
    aggs = [F.avg(ext).alias(f"{value}_mean"), F.var_samp(ext).alias(f"{value}_var"), F.count(ext).alias(f"{value}_n_valid"), F.abs(one(own) - one(partner)).alias(f"{value}_self_partner_diff"), F.abs(one(own) - F.avg(ext)).alias(f"{value}_self_external_diff")]
    if with_range:
        aggs.append((F.max(ext) - F.min(ext)).alias(f"{value}_range"))
    return raters.groupBy(*unit).agg(*aggs)


def viewer_groups(trials: DataFrame, item: str = "item", subject: str = "subject") -> DataFrame:
    """(item, viewers): sorted distinct subjects joined by a bar."""
    return trials.groupBy(item).agg(F.concat_ws("|", F.array_sort(F.collect_set(F.col(subject).cast("string")))).alias("viewers"))


def coverage_structure(trials: DataFrame, item: str = "item", subject: str = "subject") -> DataFrame:
    """One row: items, items with one and two viewers, mean, median and most viewers, distinct pairs."""
    per = trials.groupBy(item).agg(F.count_distinct(subject).alias("v"), F.array_sort(F.collect_set(subject)).alias("who"))
    return per.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("v") == 1).alias("one"), F.count_if(F.col("v") == 2).alias("two"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.max("v").alias("most"), F.count_distinct(F.when(F.col("v") >= 2, F.col("who"))).alias("groups"))


def source_overlap(a: DataFrame, b: DataFrame, labels: DataFrame | None, item: str = "item", subject: str = "subject") -> DataFrame:
    """One row of set sizes: pairs and items in a, in b, in both, share of each, label coverage.

    Presence flags are gathered per pair and then per item, in grouped passes over parts that
    don't grow with the tables, instead of set operations.
    """
    here = lambda df, k: df.select(item, subject, *[F.lit(int(x == k)).alias(x) for x in "ab"])
    rows = spread(here(a, "a").unionByName(here(b, "b")), item, subject)
    pairs = keep(rows.groupBy(item, subject).agg(F.max("a").alias("a"), F.max("b").alias("b")))

    def sizes(has: DataFrame, name: str, labelled: bool) -> DataFrame:
        both = (F.col("a") == 1) & (F.col("b") == 1)
        aggs = [F.sum("a").alias(f"{name}_a"), F.sum("b").alias(f"{name}_b"), F.count_if(both).alias(f"{name}_both")]
        if labelled:
            aggs += [F.count_if(both & (F.col("l") == 1)).alias(f"{name}_labelled"), F.count_if(both & (F.col("l") == 0)).alias(f"{name}_unlabelled")]
        return has.agg(*aggs).select(F.lit(1).alias("one"), "*")

    items = pairs.select(item, "a", "b", F.lit(0).alias("l"))
    if labels is not None:
        items = items.unionByName(labels.select(item, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("l")))
    per_item = items.groupBy(item).agg(*[F.max(k).alias(k) for k in "abl"])
    row = sizes(pairs, "pairs", False).join(sizes(per_item, "items", labels is not None), "one").drop("one")
    out = row.withColumn("pairs_share_a", div("pairs_both", "pairs_a")).withColumn("pairs_share_b", div("pairs_both", "pairs_b"))
    return out.withColumn("label_share", div("items_labelled", "items_both")).withColumn("covered", F.col("label_share") >= 0.95) if labels is not None else out

