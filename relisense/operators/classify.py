"""Scores as classifiers: confusion, ROC, AUC and its tests, calibration, overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relisense.functions import tails
from relisense.functions.columns import as_col, div
from relisense.functions.keep import keep
from relisense.functions.ordered import running_sums
from relisense.functions.quantiles import keyed_quantiles, quantiles
from relisense.operators.ranks import average_rank, value_ranks

#: Variance floor of the DeLong test.
VARIANCE_MIN = 1e-12
#: Rank error of the quantiles that each split is calibrated by: one in so many.
SPLIT_ACCURACY = 100_000
#: Distinct pairs of label and score that are broadcast (40 MB) to the tasks that run whole splits.
CELLS_MAX = 2_000_000


def long_scores(df: DataFrame, scores: list[str], label: str = "label") -> DataFrame:
    """(method, label, score), a row per record and score; missing scores are left out."""
    each = F.array(*[F.struct(F.lit(s).alias("method"), F.col(s).cast("double").alias("score")) for s in scores])
    return df.select(F.col(label).cast("int").alias("label"), F.explode(each).alias("_s")).select("_s.method", "label", "_s.score").where("score is not null and label is not null")


def auc(rows: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(keys, n, auc): from the positives' average ranks; NULL for a single class."""
    r = average_rank(rows, keys, score, "_r")
    pos = F.col(label) == 1
    m, n = F.count_if(pos), F.count(F.lit(1))
    value = div(F.sum(F.when(pos, F.col("_r"))) - m * (m + 1) / 2, m * (n - m))
    return r.groupBy(*keys).agg(n.alias("n"), value.alias("auc"))


def confusion(rows: DataFrame, keys: list[str], threshold: Column | float, score: str = "score", label: str = "label") -> DataFrame:
    """(keys, tp, fp, tn, fn, accuracy, sensitivity, specificity, gmean) at score >= threshold."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    counts = rows.groupBy(*keys).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))
    sens, spec = F.coalesce(div("tp", F.col("tp") + F.col("fn")), F.lit(0.0)), F.coalesce(div("tn", F.col("tn") + F.col("fp")), F.lit(0.0))
    acc = div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return counts.withColumn("accuracy", acc).withColumn("sensitivity", sens).withColumn("specificity", spec).withColumn("gmean", F.sqrt(F.col("sensitivity") * F.col("specificity")))


def classification(rows: DataFrame, keys: list[str], threshold: Column | float) -> DataFrame:
    return confusion(rows, keys, threshold).join(auc(rows, keys), keys)


def all_versus_valid(rows: DataFrame, threshold: Column | float, fail: str = "fail") -> DataFrame:
    """auc and gmean over all rows and over those that did not fail, and whether failures drive them."""
    both = rows.withColumn("subset", F.explode(F.when(F.col(fail), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("valid")))))
    t = classification(both, ["subset"], threshold)
    pick = lambda c, s: F.max(F.when(F.col("subset") == s, F.col(c)))
    out = t.agg(*[pick(c, s).alias(f"{c}_{s}") for c in ("auc", "gmean") for s in ("all", "valid")])
    out = out.withColumn("delta_auc", F.col("auc_all") - F.col("auc_valid")).withColumn("delta_gmean", F.col("gmean_all") - F.col("gmean_valid"))
    return out.withColumn("fails_drive", F.col("delta_auc") > 0.05)


def _roc(rows: DataFrame, keys: list[str]) -> DataFrame:
    per = rows.groupBy(*keys, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    whole = rows.groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("_m"), F.count_if(F.col("label") != 1).alias("_n"))
    below = running_sums(per, keys, "score", ["p", "q"])
    out = below.join(whole, keys).withColumn("tp", F.col("_m") - F.col("p_before")).withColumn("fp", F.col("_n") - F.col("q_before"))
    return out.select(*keys, F.col("score").alias("threshold"), "tp", "fp", div("tp", "_m").alias("tpr"), div("fp", "_n").alias("fpr"), div("tp", F.col("tp") + F.col("fp")).alias("precision"), div("p", "_m").alias("_step"))


def roc_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold, tp, fp, tpr, fpr, precision), a row per distinct score.

    Records are counted per distinct score; what lies at or above one is the whole less the
    running sum below it, so no task holds a key.
    """
    return _roc(rows, keys).drop("_step")


def average_precision(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ap): sum of recall steps times precision."""
    return _roc(rows, keys).groupBy(*keys).agg(F.sum(F.col("_step") * F.col("precision")).alias("ap"))


def threshold_curve(rows: DataFrame, keys: list[str], points: int = 300) -> DataFrame:
    """(keys, threshold, tpr, fpr) at evenly spaced thresholds from the least to the largest score.

    Each record is counted once, at the last threshold that it reaches; running sums do the rest.
    """
    ends = rows.groupBy(*keys).agg(F.min("score").alias("_a"), F.max("score").alias("_b"), F.count_if(F.col("label") == 1).alias("_m"), F.count_if(F.col("label") != 1).alias("_n"))
    grid = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("threshold", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("i") / (points - 1))
    last = F.greatest(F.lit(0), F.least(F.lit(points - 1), F.coalesce(F.floor(div(F.col("score") - F.col("_a"), F.col("_b") - F.col("_a")) * (points - 1) + 1e-9), F.lit(points - 1)))).cast("int")
    per = rows.join(ends, keys).groupBy(*keys, last.alias("i")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    up = Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(per, [*keys, "i"], "left").fillna(0, ["p", "q"]).withColumn("tp", F.sum("p").over(up)).withColumn("fp", F.sum("q").over(up))
    return out.select(*keys, "threshold", div("tp", "_m").alias("tpr"), div("fp", "_n").alias("fpr"))


def operating_points(df: DataFrame, scores: list[str], label: str = "label", fraction: float = 0.5) -> DataFrame:
    """(method, threshold, tpr, fpr) at each score's own quantile."""
    rows = long_scores(df, scores, label)
    cut = keyed_quantiles(rows, ["method"], "score", {"threshold": fraction})
    t = confusion(rows.join(cut, "method"), ["method", "threshold"], F.col("threshold"))
    return t.select("method", "threshold", F.col("sensitivity").alias("tpr"), (1 - F.col("specificity")).alias("fpr"))


def delong(df: DataFrame, a: str, b: str, label: str = "label") -> DataFrame:
    """One row: auc_a, auc_b, diff, var, z, p of the test for correlated AUCs.

    Structural components come from average ranks over all records and within the class;
    their covariances are plain aggregates.
    """
    rows = df.select(F.monotonically_increasing_id().alias("id"), F.col(label).cast("int").alias("label"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    # ranks of both scores over all records and within the class: one long table of (subset, score)
    rows = keep(rows.withColumn("one", F.lit(1)))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("which"), subset.alias("subset"), F.col(s).alias("v")) for s in ("a", "b") for subset in (F.lit(-1), F.col("label"))]))
    places = value_ranks(rows.select(each.alias("_e")).select("_e.*"), ["which", "subset"], "v", "r")
    for s in ("a", "b"):
        mine = places.where(F.col("which") == s)
        rows = rows.join(mine.where("subset = -1").select(F.col("v").alias(s), F.col("r").alias(f"all_{s}")), s).join(mine.where("subset >= 0").select(F.col("subset").alias("label"), F.col("v").alias(s), F.col("r").alias(f"own_{s}")), ["label", s])
    size = rows.groupBy("one").agg(F.count_if(F.col("label") == 1).cast("double").alias("m"), F.count_if(F.col("label") == 0).cast("double").alias("n"))
    rows = rows.join(size, "one")
    part = lambda s: F.when(F.col("label") == 1, (F.col(f"all_{s}") - F.col(f"own_{s}")) / F.col("n")).otherwise(1 - (F.col(f"all_{s}") - F.col(f"own_{s}")) / F.col("m"))
    rows = rows.withColumn("va", part("a")).withColumn("vb", part("b"))
    by = rows.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.avg("va").alias("ma"), F.avg("vb").alias("mb"), F.var_samp(F.col("va") - F.col("vb")).alias("s"))
    out = by.agg(F.max(F.when(F.col("label") == 1, F.col("ma"))).alias("auc_a"), F.max(F.when(F.col("label") == 1, F.col("mb"))).alias("auc_b"), F.greatest(F.sum(F.col("s") / F.col("k")), F.lit(VARIANCE_MIN)).alias("var"))
    out = out.withColumn("diff", F.col("auc_a") - F.col("auc_b")).withColumn("z", F.col("diff") / F.sqrt("var"))
    return out.withColumn("p", tails.norm_sf2(F.col("z")))


def paired_comparison(df: DataFrame, pairs: list[tuple[str, str]], label: str = "label") -> DataFrame:
    """(a, b, n, auc_a, auc_b, diff, var, z, p, ap_a, ap_b), a row per pair of score columns of one table.

    All scores are compared on the records that have all of them; average precisions come
    from one pass over all scores.
    """
    names = sorted({c for p in pairs for c in p})
    rows = keep(df.dropna(subset=[label, *names]))
    ap = keep(average_precision(long_scores(rows, names, label), ["method"]))
    n = rows.count()
    out = None
    for a, b in pairs:  # as many as there are pairs of scores
        side = lambda x, c: ap.where(F.col("method") == x).select(F.col("ap").alias(c))
        t = delong(rows, a, b, label).join(F.broadcast(side(a, "ap_a"))).join(F.broadcast(side(b, "ap_b")))  # single rows
        t = t.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(n).cast("long").alias("n"), "*")
        out = t if out is None else out.unionByName(t)
    return out


def resampled_auc(df: DataFrame, scores: list[str], label: str = "label", replicas: int = 2000, seed: int = 42) -> DataFrame:
    """(replica, method, auc), replica 0 being the records as they are.

    Records equal in label and scores are one cell; in each replica a cell of n records weighs
    a Poisson draw of mean n, from a stream of its own, so every score sees the same draws.
    Cells are sorted by score over all tasks; a task runs through its range with one number
    a replica for positives, negatives and pairs in order, and the ranges' numbers are put
    together per replica. No task holds the records.
    """
    clean = df.select(F.col(label).cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in scores]).dropna()
    cells = clean.groupBy("label", *scores).agg(F.count(F.lit(1)).alias("n")).withColumn("stream", F.xxhash64(F.lit(seed), "label", *scores))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("method"), F.col(c).alias("score")) for c in scores]))
    rows = cells.select("label", "n", "stream", each.alias("_s")).select("_s.method", "_s.score", "label", "n", "stream")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, method, score = TaskContext.get().partitionId(), None, None
        pos = neg = pairs = tie_pos = tie_neg = None

        def close_tie() -> None:
            nonlocal pairs, pos, neg, tie_pos, tie_neg
            pairs = pairs + tie_pos * (neg + tie_neg / 2)
            pos, neg = pos + tie_pos, neg + tie_neg
            tie_pos, tie_neg = np.zeros(replicas + 1), np.zeros(replicas + 1)

        def done() -> pd.DataFrame:
            close_tie()
            return pd.DataFrame({"method": [method], "part": [part], "pos": [pos], "neg": [neg], "pairs": [pairs]})

        for batch in batches:
            for m, x, y, n, stream in batch[["method", "score", "label", "n", "stream"]].itertuples(index=False):
                if m != method:
                    if method is not None:
                        yield done()
                    method, score = m, x
                    pos, neg, pairs, tie_pos, tie_neg = (np.zeros(replicas + 1) for _ in range(5))
                elif x != score:
                    close_tie()
                    score = x
                draws = np.random.Generator(np.random.Philox(key=stream & (1 << 64) - 1)).poisson(n, replicas)
                side = tie_pos if y == 1 else tie_neg
                side[0] += n
                side[1:] += draws
        if method is not None:
            yield done()

    sums = rows.repartitionByRange("method", "score").sortWithinPartitions("method", "score").mapInPandas(run, "method string, part int, pos array<double>, neg array<double>, pairs array<double>")
    per = sums.select("method", "part", F.posexplode(F.arrays_zip("pos", "neg", "pairs")).alias("replica", "_v")).select("method", "replica", F.struct("part", "_v.pos", "_v.neg", "_v.pairs").alias("_v"))
    per = per.groupBy("method", "replica").agg(F.array_sort(F.collect_list("_v")).alias("v"))  # a row per range of scores
    begin = F.struct(*[F.lit(0.0).alias(c) for c in ("pos", "neg", "pairs")])
    total = F.aggregate("v", begin, lambda a, x: F.struct((a["pos"] + x["pos"]).alias("pos"), (a["neg"] + x["neg"]).alias("neg"), (a["pairs"] + x["pairs"] + x["pos"] * a["neg"]).alias("pairs")))
    return per.withColumn("t", total).select("replica", "method", div("t.pairs", F.col("t.pos") * F.col("t.neg")).alias("auc"))


def bootstrap_auc(df: DataFrame, a: str, b: str, label: str = "label", replicas: int = 2000, seed: int = 42) -> DataFrame:
    """One row: diff, ci_low, ci_high, p, used: paired bootstrap of the AUC difference.

    Any number of records (see resampled_auc). Replicas of one class only are left out.
    """
    each = resampled_auc(df, [a, b], label, replicas, seed)
    d = each.groupBy("replica").agg((F.max(F.when(F.col("method") == a, F.col("auc"))) - F.max(F.when(F.col("method") == b, F.col("auc")))).alias("d"))
    drawn = F.when(F.col("replica") > 0, F.col("d"))
    q = lambda f: F.percentile(drawn, F.lit(f))
    tail = 2 * F.least(F.avg((drawn <= 0).cast("double")), F.avg((drawn >= 0).cast("double")))
    return d.agg(F.max(F.when(F.col("replica") == 0, F.col("d"))).alias("diff"), q(0.025).alias("ci_low"), q(0.975).alias("ci_high"), F.least(tail, F.lit(1.0)).alias("p"), F.count(drawn).alias("used"))


def weighted_quantile(x: np.ndarray, n: np.ndarray, q: float) -> float | None:
    """Of sorted values that stand for n records each, with linear interpolation; None without any."""
    upto = np.cumsum(n)
    if not len(upto) or not upto[-1]:
        return None
    place = q * (upto[-1] - 1)
    low, high = (x[np.searchsorted(upto, k, side="right")] for k in (math.floor(place), math.ceil(place)))
    return float(low + (high - low) * (place - math.floor(place)))


def split_auc(label: np.ndarray, sigma: np.ndarray, n: np.ndarray, fit: np.ndarray) -> float | None:
    """AUC of the U score over n - fit records of each cell, calibrated on fit of them; cells are sorted by sigma."""
    eps = weighted_quantile(sigma[sigma > 0], fit[sigma > 0], 0.01)
    eps = 1e-6 if eps is None else eps
    on = sigma >= eps
    x = np.log(np.maximum(sigma, 0) + 1e-9)
    med = weighted_quantile(x[on], fit[on], 0.5)
    if med is None:
        return None
    off = np.abs(x - med)
    order = np.argsort(off[on], kind="stable")
    mad = 1.4826 * weighted_quantile(off[on][order], fit[on][order], 0.5)
    score = np.where(on, np.exp(-0.5 * (off / (mad if mad > 0 else 1.0)) ** 2), 0.0)
    _, place = np.unique(score, return_inverse=True)
    rest = n - fit
    pos, neg = (np.bincount(place, rest * (label == c)) for c in (1, 0))
    if not pos.sum() or not neg.sum():
        return None
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))


def split_half(df: DataFrame, sigma: str, label: str = "label", splits: int = 200, seed: int = 42, cells_max: int = CELLS_MAX) -> DataFrame:
    """(split, auc): calibrated on one random half, scored on the other.

    Records of equal label and sigma are a cell; a split draws how many of each cell are in
    the half to fit on, so halves depend on nothing but the records, the seed and the split.
    Up to ``cells_max`` cells (20 bytes each) are broadcast and a task runs whole splits, with
    exact quantiles and ranks. Beyond, records are dealt by the hash of their cell and their
    number in it, quantiles of a half come from sketches of bounded size (SPLIT_ACCURACY) and
    ranks are keyed by split, so that no task holds a half.
    """
    spark = df.sparkSession
    cells = keep(df.select(F.col(label).cast("int").alias("label"), F.col(sigma).cast("double").alias("s")).dropna().groupBy("label", "s").agg(F.count(F.lit(1)).alias("n")))
    if cells.count() > cells_max:
        return _split_half_dealt(cells, splits, seed)
    table = cells.toPandas().sort_values(["s", "label"])  # cells_max rows at most
    sent = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("label", "s", "n")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, values, n = sent.value
        for batch in batches:
            each = [split_auc(marks, values, n, np.random.Generator(np.random.Philox(key=[seed, int(k)])).binomial(n, 0.5)) for k in batch["split"]]
            yield pd.DataFrame({"split": batch["split"], "auc": pd.Series(each, dtype="float64", index=batch.index)})

    tasks = min(splits, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, splits, 1, tasks).withColumnRenamed("id", "split").mapInPandas(run, "split long, auc double")


def _split_half_dealt(cells: DataFrame, splits: int, seed: int) -> DataFrame:
    rows = cells.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    each = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("fit", F.pmod(F.xxhash64(F.lit(seed), "label", "s", "_i", "split"), F.lit(2)) == 0)
    at = lambda c, q: F.percentile_approx(c, q, SPLIT_ACCURACY)
    log = F.log(F.col("s") + 1e-9)
    fit = each.where("fit")
    eps = fit.groupBy("split").agg(F.coalesce(at(F.when(F.col("s") > 0, F.col("s")), 0.01), F.lit(1e-6)).alias("eps"))
    med = fit.join(F.broadcast(eps), "split").where("s >= eps").groupBy("split", "eps").agg(at(log, 0.5).alias("med"))  # a row per split
    mad = fit.join(F.broadcast(med), "split").where("s >= eps").groupBy("split", "eps", "med").agg((1.4826 * at(F.abs(log - F.col("med")), 0.5)).alias("mad"))
    score = F.when(F.col("s") < F.col("eps"), 0.0).otherwise(F.exp(-0.5 * ((F.log(F.greatest(F.col("s"), F.lit(0.0)) + 1e-9) - F.col("med")) / F.when(F.col("mad") > 0, F.col("mad")).otherwise(1.0)) ** 2))
    scored = keep(each.where("not fit").join(F.broadcast(keep(mad)), "split").select("split", "label", score.alias("score")))
    return auc(scored, ["split"]).select(F.col("split").cast("long").alias("split"), "auc")


def split_summary(splits: DataFrame) -> DataFrame:
    q = lambda f: F.percentile("auc", F.lit(f))
    return splits.where(F.col("auc").isNotNull() & ~F.isnan("auc")).agg(F.count("auc").alias("splits"), F.avg("auc").alias("mean"), q(0.5).alias("median"), F.stddev_pop("auc").alias("std"), q(0.025).alias("ci_low"), q(0.975).alias("ci_high"))


def overlap_zone(df: DataFrame, sigma: str, label: str = "label", low: float = 0.05, high: float = 0.95) -> tuple[float, float] | None:
    """Intersection of the classes' central ranges of ln(sigma); None if empty."""
    x, y = F.log(as_col(sigma) + 1e-9), F.col(label)
    q = quantiles(df, {f"{c}{f}": (F.when((y == c) & (as_col(sigma) >= 0), x), f) for c in (0, 1) for f in (low, high)})
    if None in q.values():
        return None
    a, b = max(q[f"0{low}"], q[f"1{low}"]), min(q[f"0{high}"], q[f"1{high}"])
    return (a, b) if a <= b else None


def overlap_analysis(df: DataFrame, sigma: str, score: str, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """(part, n, in_zone): share inside the overlap zone of all, correct, misclassified, false
    positives, false negatives, and of each class."""
    zone = overlap_zone(df, sigma, label)
    x = F.log(as_col(sigma) + 1e-9)
    inside = x.between(*zone) if zone else F.lit(False)
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    parts = {"all": F.lit(True), "correct": hit == pos, "misclassified": hit != pos, "false_positive": hit & ~pos, "false_negative": ~hit & pos, "class_0": ~pos, "class_1": pos}
    each = F.array(*[F.when(c, F.lit(k)) for k, c in parts.items()])
    rows = df.where(F.col(score).isNotNull()).select(F.explode(F.array_compact(each)).alias("part"), inside.cast("double").alias("z"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("in_zone"))


def error_breakdown(df: DataFrame, sigma: str, score: str, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row: share of false negatives outside their class's p10-p90, and the false positives'
    mean distance from the global median of ln(sigma)."""
    x, pos, hit = F.log(as_col(sigma) + 1e-9), F.col(label) == 1, F.col(score) >= threshold
    q = quantiles(df, {"low": (F.when(pos, x), 0.1), "high": (F.when(pos, x), 0.9), "mid": (x, 0.5)})
    fn, fp = pos & ~hit, ~pos & hit
    return df.agg(F.count_if(fn).alias("n_fn"), F.avg(F.when(fn, (~x.between(F.lit(q["low"]), F.lit(q["high"]))).cast("double"))).alias("fn_outside"), F.count_if(fp).alias("n_fp"), F.avg(F.when(fp, F.abs(x - F.lit(q["mid"])))).alias("fp_distance"))


def with_sentinel(df: DataFrame, score: str, degenerate: str = "degenerate", name: str = "score") -> DataFrame:
    """Degenerate records get a score below the least finite one; rows that can't be evaluated go."""
    least = df.where(~F.col(degenerate)).agg(F.min(score)).first()[0]
    least = 0.0 if least is None else least
    out = df.withColumn(name, F.when(F.col(degenerate), least - (abs(least) * 0.1 + 1)).otherwise(F.col(score)))
    return out.where(F.col(name).isNotNull())


def agreement(pairs: DataFrame, keys: list[str], truth: str = "y", guess: str = "x") -> DataFrame:
    """(keys, n, ccc, rmse, mae)."""
    t, g = F.col(truth), F.col(guess)
    ccc = div(2 * F.covar_samp(t, g), F.var_samp(t) + F.var_samp(g) + (F.avg(t) - F.avg(g)) ** 2)
    return pairs.dropna(subset=[truth, guess]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ccc.alias("ccc"), F.sqrt(F.avg((t - g) ** 2)).alias("rmse"), F.avg(F.abs(t - g)).alias("mae"))
