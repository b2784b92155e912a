"""Regression forests for many training sets at once: leave-one-subject-out under several weightings.

A model per (held-out subject, weighting, tree) is grown level by level on histograms, as one
job per level for all of them. A row's part in a model is a weight (its weighting times a
Poisson draw of mean 1 from its own hash and the tree's number), so no training set is ever
made: a task goes through a slice of rows and adds up, for every model, what falls into each
node and bin; sums of equal models meet in one shuffle, where the best splits are chosen.
Inputs are cut into at most BINS bins by quantiles of all rows.

What travels through the driver are the trees of at most SUBJECTS_AT_ONCE held-out subjects
(about 600 bytes each); beyond, subjects are taken in turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relisense.functions.keep import keep

BINS, DEPTH, LEAF = 32, 5, 5
SUBJECTS_AT_ONCE, FOLDS_TOGETHER = 128, 32
#: Rows that a task goes through together.
SLICE_ROWS = 50_000
#: Chances of a Poisson draw of mean 1 being at most 0, 1, ... (beyond the last it is the next number).
_POISSON = np.cumsum(np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880], dtype=float))


def draws(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson draws of mean 1 for rows (64-bit hashes) in a tree."""
    with np.errstate(over="ignore"):
        x = row.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) / float(1 << 53), side="right")


def best_splits(sums: np.ndarray, leaf: int) -> tuple[np.ndarray, ...]:
    """(input or -1, last bin on the left, mean, mean of the left, mean of the right) per node.

    sums: (nodes, inputs, bins, 3) of rows, weights and weighted targets. The split with the
    largest gain in squared error, of equal ones the first input and bin; both sides hold at
    least ``leaf`` rows.
    """
    nodes, inputs, bins, _ = sums.shape
    left = np.cumsum(sums, axis=2)
    whole = left[:, :1, -1:, :]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 2] ** 2 / left[..., 1] + right[..., 2] ** 2 / right[..., 1] - whole[..., 2] ** 2 / whole[..., 1]
        allowed = (left[..., 0] > leaf - 0.5) & (right[..., 0] > leaf - 0.5)
        # relative to the size of what is compared, so that sums taken in another order choose alike
        scale = np.maximum(np.abs(whole[..., 2] ** 2 / whole[..., 1]), 1e-300)
        gain = np.where(allowed & (gain > 1e-9 * scale), np.round(gain / scale, 12), -1.0).reshape(nodes, inputs * bins)
        at = gain.argmax(axis=1)
        split = gain[np.arange(nodes), at] > 0
        mean = whole[:, 0, 0, 2] / whole[:, 0, 0, 1]
        side = lambda part: (part[..., 2] / part[..., 1]).reshape(nodes, inputs * bins)[np.arange(nodes), at]
        return np.where(split, at // bins, -1), at % bins, mean, side(left), side(right)


def _walk(tree_input: np.ndarray, tree_cut: np.ndarray, fold: np.ndarray, bins, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, whether it was reached) after so many levels; arrays of trees are (folds, nodes)."""
    node = np.zeros(np.broadcast_shapes(fold.shape, bins(0, fold).shape), dtype=np.int64)
    open_ = np.ones(node.shape, dtype=bool)
    for _ in range(levels):
        f, cut = tree_input[fold, node], tree_cut[fold, node]
        open_ &= f >= 0
        value = bins(0, fold)
        for i in range(1, int(f.max(initial=0)) + 1):
            value = np.where(f == i, bins(i, fold), value)
        node = np.where(open_, 2 * node + 1 + (value > cut), node)
    return node, open_


class _Slice:
    """Rows of a task as arrays."""

    def __init__(self, batches: list[pa.RecordBatch], inputs: int, weights: int):
        t = pa.Table.from_batches(batches)
        num = lambda c: t.column(c).to_numpy()
        wide = lambda c, k: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        self.fold, self.y, self.u, self.hash = num("fold"), num("y"), num("u"), num("hash")
        self.bins, self.weights = wide("bins", inputs), wide("weights", weights)


def _slices(batches: Iterator[pa.RecordBatch], inputs: int, weights: int) -> Iterator[tuple[int, _Slice]]:
    """(group of trees, rows): the rows of a task come sorted by slice and group."""
    held, at = [], None
    for b in batches:
        key = b.column("slice").to_numpy() * (1 << 20) + b.column("trees").to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for start, end in zip(edges, edges[1:], strict=False):
            if start == end:
                continue
            if held and (at != key[start] or sum(map(len, held)) >= 2 * SLICE_ROWS):  # sums add up, so a slice may come in parts
                yield at % (1 << 20), _Slice(held, inputs, weights)
                held = []
            at = int(key[start])
            held.append(b.slice(start, end - start))
    if held:
        yield at % (1 << 20), _Slice(held, inputs, weights)


def _subject_batches(rows: DataFrame, subject: str) -> list[list]:
    found = sorted(r[0] for r in rows.select(subject).distinct().collect())  # a number per subject
    return [found[i : i + SUBJECTS_AT_ONCE] for i in range(0, len(found), SUBJECTS_AT_ONCE)]


def leave_one_out_forests(
    rows: DataFrame, inputs: list[str], target: str, weights: dict[str, Column], like: dict[str, str] | None = None, subject: str = "subject", trees: int = 200, depth: int = DEPTH, leaf: int = LEAF, seed: int = 42
) -> DataFrame:
    """(treatment, subject, y, x): each row predicted, per weighting, by a forest that has not seen its subject.

    weights: a column per treatment; rows without a positive one are not trained on. like:
    further treatments that keep, unweighted, a random share of the rows, as large as the
    share of the fold's rows that the named treatment trains on. Rows without target or
    subject are left out; a missing input counts as the bin of the fold's median. Rows equal
    in every column get the same draws. A fold without rows to train on has no predictions.
    """
    like = like or {}
    names, k = [*weights, *like], len(inputs)
    f = rows.where(F.col(target).isNotNull() & F.col(subject).isNotNull())
    x = [F.col(c).cast("double") for c in inputs]
    cuts = f.agg(*[F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 10_000).alias(f"c{i}") for i, c in enumerate(x)]).first()
    cuts = [sorted(set(c or [])) for c in cuts]
    bin_of = lambda c, q: F.when(c.isNotNull(), F.size(F.filter(F.array(*[F.lit(float(v)) for v in q]).cast("array<double>"), lambda v: v < c))).otherwise(-1)
    everything = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in rows.columns])
    w = F.array(*[F.coalesce(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(0.0)) for c in weights.values()], *[F.lit(1.0) for _ in like])
    narrow = f.select(F.col(subject).alias("subject"), F.col(target).cast("double").alias("y"), F.array(*[bin_of(c, q) for c, q in zip(x, cuts, strict=True)]).alias("bins"), w.alias("weights"), everything.alias("hash"))
    narrow = keep(narrow.withColumn("u", F.pmod(F.xxhash64(F.lit(seed + 1), "hash"), F.lit(1 << 20)) / float(1 << 20)))
    out = None
    for batch in _subject_batches(narrow, "subject"):
        part = _grown(narrow, batch, k, names, list(weights), like, trees, depth, leaf, seed)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return f.select(F.lit("").alias("treatment"), F.col(subject).alias("subject"), F.col(target).cast("double").alias("y"), F.lit(0.0).alias("x")).limit(0)
    return out


def _grown(rows: DataFrame, subjects: list, k: int, names: list[str], plain: list[str], like: dict[str, str], trees: int, depth: int, leaf: int, seed: int) -> DataFrame:
    spark = rows.sparkSession
    s, t, nodes = len(subjects), len(names), 2 ** (depth + 1) - 1
    place = F.broadcast(spark.createDataFrame([(x, i) for i, x in enumerate(subjects)], "subject " + dict(rows.dtypes)["subject"] + ", fold int"))
    rows = rows.join(place, "subject", "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))
    # per held-out subject: rows, rows that a treatment trains on, and inputs' bins; the rest is the whole less these
    counts = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("weights")[i] > 0).alias(f"w{i}") for i in range(t)], *[F.count_if(F.col("bins")[i] == b).alias(f"b{i}_{b}") for i in range(k) for b in range(BINS)]]
    table = np.zeros((s + 1, 1 + t + k * BINS))
    for r in rows.groupBy("fold").agg(*counts).collect():  # a row per held-out subject
        table[r["fold"]] = r[1:]
    rest = (table.sum(axis=0) - table)[:s]
    half = np.cumsum(rest[:, 1 + t :].reshape(s, k, BINS), axis=2)
    middle = (half * 2 >= half[:, :, -1:]).argmax(axis=2)  # bins of the medians
    share = np.ones((t, s))
    for i, name in enumerate(names):
        if name in like:
            share[i] = rest[:, 1 + plain.index(like[name])] / np.maximum(rest[:, 0], 1)
    n = int(table[:, 0].sum())
    slices = max(1, -(-n // SLICE_ROWS))
    groups = min(trees, max(1, -(-3 * spark.sparkContext.defaultParallelism // slices)))
    spread = rows.select("fold", "y", "u", "hash", "bins", "weights", F.pmod(F.col("hash"), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("trees"))
    spread = keep(spread.repartition(slices * groups, "slice", "trees").sortWithinPartitions("slice", "trees"))
    model_input, model_cut = np.full((trees, t, s, nodes), -1, dtype=np.int8), np.zeros((trees, t, s, nodes), dtype=np.int8)
    model_value = np.full((trees, t, s, nodes), np.nan)
    blocks = [range(a, min(s, a + FOLDS_TOGETHER)) for a in range(0, s, FOLDS_TOGETHER)]

    def bins_of(rows_: _Slice):
        return lambda i, fold: np.where((b := rows_.bins[:, i])[:, None] < 0, middle[fold, i], b[:, None]) if fold.ndim == 2 else np.where((b := rows_.bins[:, i]) < 0, middle[fold, i], b)

    for level in range(depth):
        sent = spark.sparkContext.broadcast((model_input, model_cut))
        here = 2**level

        def add_up(batches: Iterator[pa.RecordBatch], level=level, here=here, sent=sent) -> Iterator[pa.RecordBatch]:
            tree_input, tree_cut = sent.value
            for group, whole in _slices(batches, k, t):
                for b in range(group, trees, groups):
                    drawn = draws(whole.hash, b, seed)
                    for i in range(t):
                        weight = drawn * whole.weights[:, i]
                        on = np.flatnonzero(weight > 0)
                        some = _Slice.__new__(_Slice)
                        some.bins, some.fold, w, y = whole.bins[on], whole.fold[on], weight[on], whole.y[on]
                        for j, folds in enumerate(blocks):
                            fold = np.arange(folds.start, folds.stop)[None, :]
                            used = some.fold[:, None] != fold
                            if names[i] in like:
                                used &= whole.u[on][:, None] < share[i][fold]
                            node, open_ = _walk(tree_input[b, i], tree_cut[b, i], fold, bins_of(some), level)
                            r, c = np.nonzero(used & open_)
                            cell = ((c * here + node[r, c] - (here - 1)) * k)[:, None] + np.arange(k)[None, :]
                            bins = np.stack([np.broadcast_to(bins_of(some)(f, fold), used.shape)[r, c] for f in range(k)], axis=1)
                            cell = (cell * BINS + bins).ravel()
                            size = len(folds) * here * k * BINS
                            sums = np.stack([np.bincount(cell, np.repeat(v, k), size) for v in (np.ones(len(r)), w[r], (w * y)[r])], axis=1)
                            yield pa.RecordBatch.from_pydict({"block": pa.array([(b * t + i) * len(blocks) + j], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})

        def choose(batches: Iterator[pa.RecordBatch], here=here) -> Iterator[pa.RecordBatch]:
            """Sums of one block follow each other; only their total is held."""
            at, total = None, None

            def done() -> pa.RecordBatch:
                f, cut, mean, low, high = best_splits(total.reshape(-1, k, BINS, 3), leaf)
                return pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "split": pa.array([np.stack([f, cut, mean, low, high]).astype(float).tobytes()], pa.binary())})

            for batch in batches:
                for block, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    new = np.frombuffer(sums.as_buffer(), dtype=float)
                    if block == at:
                        total = total + new
                        continue
                    if at is not None:
                        yield done()
                    at, total = block, new.copy()
            if at is not None:
                yield done()

        sums = spread.mapInArrow(add_up, "block int, sums binary")
        chosen = sums.repartition(max(2, min(trees * t, 4 * spark.sparkContext.defaultParallelism)), "block").sortWithinPartitions("block").mapInArrow(choose, "block int, split binary")
        first = here - 1
        for r in chosen.collect():  # trees of at most SUBJECTS_AT_ONCE subjects
            bi, j = divmod(r["block"], len(blocks))
            b, i = divmod(bi, t)
            folds = blocks[j]
            f, cut, mean, low, high = np.frombuffer(r["split"]).reshape(5, len(folds), here)
            own = slice(folds.start, folds.stop)
            at = slice(first, first + here)
            model_input[b, i, own, at], model_cut[b, i, own, at] = f, cut
            if level == 0:
                model_value[b, i, own, at] = mean
            split = f >= 0
            children = model_value[b, i, own, 2 * first + 1 : 2 * first + 1 + 2 * here].reshape(len(folds), here, 2)
            children[..., 0], children[..., 1] = np.where(split, low, np.nan), np.where(split, high, np.nan)
        sent.unpersist()
    sent = spark.sparkContext.broadcast((model_input, model_cut, model_value))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_input, tree_cut, tree_value = sent.value
        for _, whole in _slices(batches, k, t):
            mine = np.flatnonzero(whole.fold >= 0)
            some = _Slice.__new__(_Slice)
            some.bins, fold, y = whole.bins[mine], whole.fold[mine], whole.y[mine]
            for i in range(t):
                total, count = np.zeros(len(mine)), np.zeros(len(mine))
                for b in range(trees):
                    node, _ = _walk(tree_input[b, i], tree_cut[b, i], fold, bins_of(some), depth)
                    value = tree_value[b, i][fold, node]
                    total, count = total + np.nan_to_num(value), count + ~np.isnan(value)
                has = count > 0
                yield pa.RecordBatch.from_pydict({"treatment": pa.array([names[i]] * int(has.sum()), pa.string()), "fold": pa.array(fold[has], pa.int32()), "y": pa.array(y[has]), "x": pa.array(total[has] / count[has])})

    guessed = spread.where("trees = 0").mapInArrow(predict, "treatment string, fold int, y double, x double")
    return keep(guessed.join(place, "fold").select("treatment", "subject", "y", "x"))
