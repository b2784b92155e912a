"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the hashes of its word shingles; its sketch the SKETCH smallest of
them. Documents with equal sets form a class, and only classes are compared.

1. Values that more than LIST_MAX classes retain are common, the others rare. Every class
   puts its POSTINGS smallest rare values into inverted lists. Lists give overlaps; pairs
   with enough overlap and fitting sizes are estimated from the union of their sketches.
2. A class with few rare values (a member of a large group of copies, or text made of
   passages that many share) also posts some of its smallest common values. These
   lists may be of any length. They are dealt into blocks of bounded size, and a task emits
   no more than a spanning forest of the links in its block. Sets go to the blocks of their
   first FIRST_LISTS lists and of all lists of one block; since each value deals anew, a group
   of copies comes together in this one pass. Only classes that are not in a list's largest
   component yet are then held against the list's blocks, where sizes fit, in all of their
   lists.
3. All links rest on the exact Jaccard similarity of the full sets.

How a link could be missed: at the least similarity s, each of the smallest values of the
two sets' union is common to both with probability s (4/7 at least among the rare values of
a class that takes step 1 alone). POSTINGS and the number of common postings make it less
than 1e-6 that none is shared, and an estimate is turned down only if it is five standard
errors below s.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relisense.llm.graph import components
from relisense.llm.shared import in_parts, join_hot, shared_folder, small_batches

SHINGLE_WORDS, SIMILAR_PERCENT = 3, 85
SKETCH, POSTINGS, LIST_MAX, BLOCK = 64, 24, 48, 768
#: A class's set goes to a block of so many of its longer lists of common values; in the others it
#: is compared only where it, or another class there, is still outside of the list's largest component.
FIRST_LISTS = 4
#: Below, two linked sets could share too few values for the guarantees above.
PERCENT_MIN = 75
#: Up to so many ids (107 bytes each with the hash of their text, as measured for pairs of numbers) the
#: texts to compare are picked by a broadcast; beyond, ids and texts are shuffled.
BROADCAST_IDS = 500_000
#: Words whose hashes a task keeps.
CACHED_WORDS = 250_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words_each: int = SHINGLE_WORDS, hashes: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles of a text.

    A-Z count as a-z; words are parted by ASCII white space. Fewer words than a shingle
    has: the whole sequence is one. No word: the empty set.
    """
    if not text:
        return np.zeros(0, dtype=np.int64)
    words = text.encode("utf-8").lower().split()  # bytes: only ASCII letters and spaces matter
    if not words:
        return np.zeros(0, dtype=np.int64)
    hashes = _WordHashes() if hashes is None else hashes
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(words_each, len(h))
    with np.errstate(over="ignore"):
        x = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            x = (x ^ h[i : len(h) - k + 1 + i]) * _A
            x ^= x >> np.uint64(29)
        x = (x + _B) * _C
        x ^= x >> np.uint64(32)
    return np.unique(x >> np.uint64(1)).astype(np.int64)


@dataclass(frozen=True)
class Limits:
    """What follows from the least similarity (in percent)."""

    percent: int

    def __post_init__(self):
        if not PERCENT_MIN <= self.percent <= 100:
            raise ValueError(f"the least similarity is {PERCENT_MIN} to 100 percent, not {self.percent}")

    @property
    def rare_share(self) -> float:
        """A class with a smaller share of rare values in its sketch takes part in step 2."""
        return 7 / 3 * (1 - self.percent / 100)

    @property
    def common_postings(self) -> int:
        common = 1 - (1 - self.percent / 100) / (1 - self.rare_share)  # of the common values of two linked classes in step 2
        return math.ceil(16 / -math.log(1 - common)) if common < 1 else 1

    def size_class(self, n: str) -> Column:
        """Sizes of two linked sets are in the same class or in neighbouring ones."""
        return F.floor(F.log(n) / (-math.log(self.percent / 100) * (1 + 1e-9) or math.log(2))).cast("int")

    @property
    def estimate_min(self) -> float:
        s = self.percent / 100
        return s - 5 * math.sqrt(s * (1 - s) / SKETCH)


def _sketches(docs: DataFrame, words_each: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        hashes = _WordHashes()
        for batch in in_parts(batches):
            sets = [shingle_set(t, words_each, hashes) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "text_hash": batch["text_hash"], "key": [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "n": [len(s) for s in sets], "sketch": [s[:SKETCH] for s in sets]}).astype({"id": "Int64"})

    return docs.mapInPandas(run, "id long, text_hash long, key binary, n long, sketch array<long>")


def _full_sets(docs: DataFrame, words_each: int) -> DataFrame:
    """(id, members) from (node, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in in_parts(batches):
            yield pd.DataFrame({"id": batch["node"], "members": [shingle_set(t, words_each, hashes) for t in batch["text"]]})

    return docs.mapInPandas(run, "id long, members array<long>")


def block_links(ids: np.ndarray, sets: list[np.ndarray], percent: int = SIMILAR_PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between these sets, by exact comparison of all of them.

    Sets become rows of bits over the members that two or more of them have, in slices of
    bounded width; intersections are counted by and-ing the bits.
    """
    m, size = len(ids), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    values, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
    often = seen > 1
    rank = np.cumsum(often) - 1
    keep = often[code]
    col, owner = rank[code[keep]], owner[keep]
    inter = np.zeros((m, m), dtype=np.int32)
    width = 1 << 16
    for start in range(0, int(often.sum()), width):
        part = (col >= start) & (col < start + width)
        span = min(width, int(often.sum()) - start)
        bits = np.zeros((m, (span + 63) // 64 * 64), dtype=bool)
        bits[owner[part], col[part] - start] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(m):
            inter[i] += np.bitwise_count(packed & packed[i]).sum(axis=1, dtype=np.int32)
    union = size[:, None] + size[None, :] - inter
    link = 100 * inter.astype(np.int64) >= percent * union.astype(np.int64)
    todo, out = np.ones(m, dtype=bool), []
    for root in range(m):
        if not todo[root]:
            continue
        todo[root], front = False, [root]
        while front:
            i = front.pop()
            for j in np.flatnonzero(link[i] & todo).tolist():
                todo[j] = False
                out.append((int(ids[i]), int(ids[j])))
                front.append(j)
    return out


def text_hash(text: str = "text") -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(text)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = SHINGLE_WORDS, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """One row per row of docs: id, text_hash, n_shingles, component_id, kept.

    component_id is the smallest id that links reach, the row's own included; kept is true
    where it is the row's own. Null and wordless texts have the empty set and no link. Rows
    without id have no component and are not kept; repeated rows share a component, and
    different texts under one id are compared each on its own. Long texts are taken whole.
    Other columns are not read. An empty table gives no rows. percent: PERCENT_MIN to 100.
    """
    spark, limits = docs.sparkSession, Limits(percent)
    folder = shared_folder(spark, "neardup")
    small_batches(spark)
    names = count()

    def written(df: DataFrame) -> DataFrame:
        df.write.parquet(path := f"{folder}/{next(names)}")
        return spark.read.parquet(path)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    all_docs = written(_sketches(texts, words_each))
    firsts = all_docs.where("key is not null and id is not null").groupBy("key").agg(F.min(F.struct("id", "text_hash")).alias("f")).select("key", "f.id", "f.text_hash")
    # a class goes by its first id; where one id is the first of several classes, all but one go by a number of their own
    again = firsts.groupBy("id").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    own_number = -1 - F.xxhash64("key").bitwiseAND((1 << 62) - 1)
    firsts = firsts.join(again, "id", "left").withColumn("node", F.when(F.col("key") != F.col("least"), own_number).otherwise(F.col("id"))).drop("least")
    firsts = written(firsts)
    classes = written(all_docs.select("id", "text_hash", "key", "n", "sketch").join(firsts, ["key", "id", "text_hash"]).dropDuplicates(["key"]).select(F.col("node").alias("id"), "n", "sketch"))

    # values that many classes retain; a row per value after partial aggregation
    values = classes.select("id", F.explode("sketch").alias("value"))
    common = written(values.groupBy("value").count().where(F.col("count") > LIST_MAX))
    marked = join_hot(values, common.withColumn("common", F.lit(True)), "value", "count", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("common").isNull(), F.col("value")))).alias("rare"), F.sort_array(F.collect_list(F.when(F.col("common"), F.col("value")))).alias("common"))
    marked = marked.withColumn("few", F.size("rare") < limits.rare_share * (F.size("rare") + F.size("common")))
    lists = written(marked.select("id", F.slice("rare", 1, POSTINGS).alias("rare"), F.when(F.col("few"), F.slice("common", 1, limits.common_postings)).alias("common")))

    # step 1: overlaps in the lists of rare values (each of LIST_MAX classes at most)
    posted = lists.select("id", F.size("rare").alias("q"), F.explode("rare").alias("value"))
    left, right = (posted.select("value", F.col("id").alias(x), F.col("q").alias(f"q{x}")) for x in "ab")
    overlaps = left.join(right, "value").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.least(F.first("qa"), F.first("qb")).alias("q"))
    pairs = overlaps.where("shared >= if(q >= 20, 3, 1)").select("a", "b")
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH)
    near = F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) / F.size(union)
    pairs = written(pairs.where(near >= limits.estimate_min).select("a", "b"))

    # step 2: common values, in blocks
    shared = lists.where("common is not null").select("id", F.posexplode("common").alias("nth", "value"))
    lengths = written(shared.groupBy("value").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")))
    dealt = written(join_hot(shared, lengths, "value", "count").withColumn("own", F.pmod(F.xxhash64("id", "value"), "blocks").cast("int")).select("id", "value", "nth", "blocks", "own"))

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(dealt.select(F.col("id").alias("node"))).distinct()
    wanted = written(firsts.join(wanted, "node", "left_semi").select("node", "id", "text_hash"))
    hint = F.broadcast if wanted.count() <= BROADCAST_IDS else lambda df: df
    sets = written(_full_sets(texts.join(hint(wanted), ["id", "text_hash"]).select("node", "text"), words_each).dropDuplicates(["id"]))

    of = lambda x: sets.select(F.col("id").alias(x), F.col("members").alias(f"m{x}"))
    inter = F.size(F.array_intersect("ma", "mb"))
    links = pairs.join(of("a"), "a").join(of("b"), "b").where(100 * inter >= percent * (F.size("ma") + F.size("mb") - inter)).select("a", "b")

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        one = group.drop_duplicates("id")
        return pd.DataFrame(block_links(one["id"].to_numpy(), one["members"].tolist(), percent), columns=["a", "b"], dtype="int64")

    inside = dealt.where((F.col("nth") < FIRST_LISTS) | (F.col("blocks") == 1)).select("id", "value", "own").join(sets, "id").groupBy("value", "own").applyInPandas(forest, "a long, b long")
    found = components(written(links.unionByName(inside)))
    if across := _across(dealt, found, classes, sets, limits, written):
        more = across.groupBy("value", "sizes", "lane", "own").applyInPandas(forest, "a long, b long")
        found = components(written(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)))

    labelled = firsts.join(found.select(F.col("id").alias("node"), "component"), "node", "left").select("key", "id", "node", F.coalesce("component", "node").alias("component"))
    if not firsts.where("node <> id").isEmpty():  # numbers made up for repeated ids give way to ids
        labelled = written(labelled)
        least = labelled.groupBy("component").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("count"))
        labelled = join_hot(labelled, least, "component", "count").withColumn("component", F.col("least"))
    labelled = labelled.select("key", "component")
    own = all_docs.select("id", "text_hash", "key", "n")
    out = own.where("key is not null").join(labelled, "key", "left").unionByName(own.where("key is null").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _across(dealt: DataFrame, found: DataFrame, classes: DataFrame, sets: DataFrame, limits: Limits, written) -> DataFrame | None:
    """Groups (value, sizes, lane, own) of sets in which links may remain; None if there are none.

    In each list of several blocks the classes outside of its largest component go, by size
    class, into lanes of BLOCK; a lane meets the list's blocks, of which those members come
    whose size fits.
    """
    at = dealt.where("blocks > 1").join(found, "id", "left").select(*dealt.columns, F.coalesce("component", "id").alias("component"))
    at = written(at.join(classes.select("id", limits.size_class("n").alias("sizes")), "id"))
    per = written(at.groupBy("value", "component").count())
    core = per.groupBy("value").agg(F.max_by("component", F.struct("count", "component")).alias("component"), F.count(F.lit(1)).alias("c")).where("c > 1")
    core = written(core.select("value", "component"))
    if core.isEmpty():
        return None
    others = per.join(core, ["value", "component"], "left_anti").join(core, "value", "left_semi").select("value", "component")
    outside = written(at.join(others, ["value", "component"], "left_semi"))
    lanes = outside.groupBy("value", "sizes").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("lanes"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = outside.join(lanes, ["value", "sizes"]).withColumn("lane", F.pmod(F.xxhash64("value", "id"), "lanes").cast("int")).withColumn("own", each("blocks"))
    members = at.withColumn("sizes", F.explode(F.sequence(F.col("sizes") - 1, F.col("sizes") + 1))).join(lanes, ["value", "sizes"]).withColumn("lane", each("lanes"))
    keys = ["id", "value", "sizes", "lane", "own"]
    return out.select(keys).unionByName(members.select(keys)).join(sets, "id")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
