"""Audit of how document filters interact, over every order in which they can be applied.

Orders share their beginnings: what is left after some filters depends on which were applied,
not on their order. The trie of permutations is walked depth first; each set of applied
filters is one state, whose surviving rows are persisted while the states below it are
visited and counted once. A state's single aggregation counts, per part of the corpus and
for each filter not yet applied, what that filter removes there: one count per edge of the
trie. All orders are then read off these edges.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relisense.llm.shared import join_hot, shared_root

_WORDS = r"[\x20\x09-\x0D]+"
#: Parts whose counts in a state are written by one task.
PARTS_PER_TASK = 50_000
COUNTS = ("removed", "good_lost", "toxic_lost")


def base_failures(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text (not null) fails."""
    words = F.filter(F.split(text, _WORDS), lambda w: w != "")
    n = lambda w: F.size(w)
    both = F.transform(F.array(words), lambda w: F.struct(n(w).alias("n"), n(F.array_distinct(w)).alias("distinct")))[0]
    return {
        "A": both["n"] < 50,
        "B": 100 * both["distinct"].cast("long") < 65 * both["n"].cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic): a row per document, checkpointed, without its text.

    E is a text that a smaller id holds, anywhere in the table; equal texts are found by
    SHA-256. Null texts are empty ones, a null part is the empty string. A document without
    id fails E as little as it makes others fail; documents that share an id and a text
    don't fail it by each other. A document is good (toxic) if any row of labels (doc_id,
    quality, toxic) says 1.
    """
    shared_root(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    one = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # split once: the words of a text are an array that the two conditions on words share
    rows = one.select("id", "part", F.sha2("text", 256).alias("key"), *[c.alias(k) for k, c in base_failures(F.col("text")).items()]).checkpoint()
    total = rows.count()
    first = rows.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = join_hot(rows, first, "key", "copies", "left", total)
    rows = rows.withColumn("E", F.coalesce(F.col("first") < F.col("id"), F.lit(False))).drop("first", "key")
    good = toxic = F.lit(False)
    if labels is not None:
        marks = labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
        marks = marks.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
        rows = rows.join(marks, "id", "left")
        good, toxic = F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False))
    return rows.select("part", "A", "B", "C", "D", "E", good.alias("good"), toxic.alias("toxic")).checkpoint()


def trie_edges(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, state, filter, survivors, removed, good_lost, toxic_lost), a row per part and edge whose state has survivors.

    rows: part, a boolean per filter (fails it), good, toxic. ``state`` is the sorted letters
    of the filters applied before. Every state is visited once, depth first; its survivors
    are persisted (on executors' disks where memory is short, rebuilt from the parent's if
    an executor is lost) until the states below have been counted.
    """
    counted: dict[str, DataFrame] = {}
    # a state's table has a row per part and edge; many states with many partitions each would make a shuffle of very many blocks
    files = max(1, -(-rows.select("part").distinct().count() // PARTS_PER_TASK))

    def visit(state: str, survivors: DataFrame) -> None:
        rest = [f for f in filters if f not in state]
        below = ["".join(sorted(state + f)) for f in rest]
        open_ = [(f, s) for f, s in zip(rest, below, strict=True) if s not in counted and len(s) < len(filters)]
        if open_:
            survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counts = [F.struct(F.lit(f).alias("filter"), F.count_if(f).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good_lost"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic_lost")) for f in rest]
        table = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("survivors"), F.array(*counts).alias("_edges"))
        counted[state] = table.coalesce(files).select("part", F.lit(state).alias("state"), "survivors", F.explode("_edges").alias("_e")).select("part", "state", "_e.filter", "survivors", *[f"_e.{c}" for c in COUNTS]).checkpoint()
        for f, s in open_:
            if s not in counted:
                visit(s, survivors.where(~F.col(f)).drop(f))
        if open_:
            survivors.unpersist()

    visit("", rows)
    tables = list(counted.values())
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def interactions(edges: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A row per part, order of all filters and step, zeros included. A part's edges are at most
    a fixed number, so they are put together in one array; the orders are a fixed list.
    """
    n = len(filters)
    mine = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("state", F.lit(">"), "filter"), F.struct("survivors", *COUNTS)))).alias("_e"))
    steps = [(o, k + 1, "".join(sorted(o[:k])), o[k]) for o in map("".join, permutations(filters)) for k in range(n)]
    each = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(f).alias("f")) for o, k, s, f in steps])
    others = {f: "".join(x for x in sorted(filters) if x != f) for f in filters}
    at = lambda state, f, what: F.coalesce(F.col("_e")[F.concat(F.lit(state), F.lit(">"), F.lit(f))][what], F.lit(0).cast("long"))
    states = lambda f: ["".join(x for i, x in enumerate(others[f]) if mask >> i & 1) for mask in range(1 << (n - 1))]

    def shapley(f: str) -> Column:
        total = F.lit(0).cast("long")
        for s in states(f):
            total = total + at(s, f, "removed") * (factorial(len(s)) * factorial(n - 1 - len(s)))
        return total

    whole = {f: F.struct(at("", f, "removed").alias("fails"), at(others[f], f, "removed").alias("alone"), shapley(f).alias("shapley")) for f in filters}
    summed = mine.select("part", "_e", F.create_map(*[x for f in filters for x in (F.lit(f), whole[f])]).alias("_f"))
    rows = summed.select("part", "_e", "_f", F.explode(each).alias("_s"))
    edge = F.col("_e")[F.concat(F.col("_s.s"), F.lit(">"), F.col("_s.f"))]
    rows = rows.select("part", F.col("_s.o").alias("filter_order"), F.col("_s.k").alias("step"), edge.alias("_x"), F.col("_f")[F.col("_s.f")].alias("_t"))
    got = lambda c: F.coalesce(F.col(f"_x.{c}"), F.lit(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step", (got("survivors") - got("removed")).alias("kept"), got("removed").alias("removed"), (F.col("_t.fails") - got("removed")).alias("redundant"),
        F.col("_t.alone").alias("unique_fails"), got("good_lost").alias("good_lost"), got("toxic_lost").alias("toxic_lost"), F.col("_t.shapley").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The interactions of the filters A to E over docs (see ``flagged`` and ``interactions``).

    Empty and null texts are documents without words (they fail A); long texts are read
    whole; repeated rows count each; columns beside those named are not read; an empty table
    gives no rows. No count depends on which row of a tie comes first.
    """
    return interactions(trie_edges(flagged(docs, labels, id_col, text_col, part_col)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_ORDERS = ", ".join(f"('{o}')" for o in map("".join, permutations("ABCDE")))
SQL = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS w, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(w) < 50 AS A, 100 * len(list_distinct(w)) < 65 * len(w) AS B, 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) AS C,
  regexp_matches(x, '[#$%&*|]') AS D, coalesce(first < w.doc_id, false) AS E, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
p AS (SELECT part, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END, CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS fails,
  count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
o AS (SELECT filter_order, step, filter_order[step] AS k, filter_order[1:step - 1] AS before FROM (VALUES {_ORDERS}) v(filter_order), range(1, 6) s(step)),
c AS (SELECT part, filter_order, step, k, contains(fails, k) AS hit, translate(fails, before, '') <> fails AS gone, fails = k AS alone, n, g, x FROM p, o),
s AS (SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(g) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(x) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley FROM s"""
