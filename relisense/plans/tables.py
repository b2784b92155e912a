"""The studies' input tables, made from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relisense.functions.columns import nan_to_null
from relisense.functions.spread import spread

DAY = 86400.0
CORE, AUX = ["hr", "eda", "bvp"], ["attention", "acc"]
CHANNELS = {"view": "hr", "click": "eda", "error": "bvp", "signup": "attention", "purchase": "acc"}
RATERS = {1: "R1", 2: "R2", 3: "R3", 4: "R4", 5: "R5", 6: "self", 7: "partner"}
EXTERNAL = ["R1", "R2", "R3", "R4", "R5"]
LEADS, LEAD_SAMPLES = 8, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, channel, axis, t, value, pos)."""
    e = table(spark, sf_dir, "events")
    name = F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv])
    return e.select((F.col("user_id") % 30).alias("subject"), name[F.col("event_type")].alias("channel"), (F.col("event_id") % 3).alias("axis"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value", F.col("event_id").alias("pos"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, rater, valence, arousal): one row per rater of a unit."""
    name = F.create_map(*[F.lit(x) for kv in RATERS.items() for x in kv])
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), name[F.col("l_linenumber")].alias("rater"), "l_quantity", "l_extendedprice")
    return rows.groupBy("unit", "rater").agg(F.avg("l_quantity").alias("valence"), F.avg("l_extendedprice").alias("arousal"))


def trials(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """(item, subject, hr, hr_std, pupil, pupil_std, rt, blinks): one row per pair.

    by: the keys by which lines are dealt, the pair if none is named. Dealt by item, an item's
    trials stay together, so that a grouping by item that follows needs no further shuffle.
    """
    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_partkey": "item", "l_suppkey": "subject"})
    return spread(lines, *(by or ("item", "subject"))).groupBy("item", "subject").agg(F.avg("l_quantity").alias("hr"), F.stddev_samp("l_quantity").alias("hr_std"), F.avg("l_extendedprice").alias("pupil"), F.stddev_samp("l_extendedprice").alias("pupil_std"), F.avg("l_discount").alias("rt"), F.avg("l_tax").alias("blinks"), F.avg("l_linenumber").alias("hr_base"), F.max("l_quantity").alias("pupil_base"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, label, leads): eight leads of eight samples."""
    e = table(spark, sf_dir, "embeddings")
    leads = F.transform(F.sequence(F.lit(0), F.lit(LEADS - 1)), lambda k: F.transform(F.slice("embedding", k * LEAD_SAMPLES + 1, LEAD_SAMPLES), lambda v: v.cast("double")))
    return e.select(F.col("vec_id").alias("record"), (F.col("label") < 5).cast("int").alias("label"), leads.alias("leads"))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, label, sigma, other): graded records with two figures to score by."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = l.join(d.select("doc_id", "n_chars", F.col("text").alias("_t")), "doc_id")
    words = F.size(F.split("_t", " "))
    return rows.select(F.col("doc_id").alias("record"), F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("sigma"), (F.col("n_chars") / words).alias("other"), "toxic")


SQL = {
    "sig": """SELECT user_id % 30 AS subject, CASE event_type WHEN 'view' THEN 'hr' WHEN 'click' THEN 'eda' WHEN 'error' THEN 'bvp' WHEN 'signup' THEN 'attention' WHEN 'purchase' THEN 'acc' END AS channel, event_id % 3 AS axis, epoch_us(ts) / 1e6 AS t, value, event_id AS pos FROM events""",
    "cells": """SELECT subject, channel, floor(t / 86400.0::DOUBLE)::BIGINT AS win, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n_samples FROM sig GROUP BY ALL""",
    "feat": "SELECT * FROM (SELECT subject, win, "
    + ", ".join(f"max(CASE WHEN channel = '{c}' THEN {v} END) AS {c}_{v}" for c in CORE for v in ("mean", "std", "n_samples"))
    + " FROM cells WHERE channel IN ('hr', 'eda', 'bvp') GROUP BY subject, win) LEFT JOIN (SELECT subject, win, "
    + ", ".join(f"max(CASE WHEN channel = '{c}' THEN {v} END) AS {c}_{v}" for c in AUX for v in ("mean", "std", "n_samples"))
    + " FROM cells WHERE channel IN ('attention', 'acc') GROUP BY subject, win) USING (subject, win)",
    "rat": """SELECT l_orderkey AS unit, CASE l_linenumber WHEN 6 THEN 'self' WHEN 7 THEN 'partner' ELSE 'R' || l_linenumber END AS rater, avg(l_quantity) AS valence, avg(l_extendedprice) AS arousal FROM lineitem GROUP BY ALL""",
    "tri": """SELECT l_partkey AS item, l_suppkey AS subject, avg(l_quantity) AS hr, stddev_samp(l_quantity) AS hr_std, avg(l_extendedprice) AS pupil, stddev_samp(l_extendedprice) AS pupil_std, avg(l_discount) AS rt, avg(l_tax) AS blinks, avg(l_linenumber) AS hr_base, max(l_quantity) AS pupil_base FROM lineitem GROUP BY ALL""",
    "smp": """SELECT vec_id AS record, (label < 5)::INT AS label, (i - 1) // 8 AS lead, (i - 1) % 8 AS i, embedding[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)""",
    "grd": """SELECT l.doc_id AS record, quality AS label, n_chars::DOUBLE AS sigma, n_chars / len(string_split(text, ' '))::DOUBLE AS other, toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}
NEEDS = {"cells": ["sig"], "feat": ["cells"]}


def with_sql(names: list[str], body: str, more: dict[str, str] | None = None) -> str:
    """A query over named common tables, with those that they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for k in NEEDS.get(n, []):
            add(k)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({SQL[n]})" for n in order] + [f"{k} AS ({v})" for k, v in (more or {}).items()]
    return f"WITH {', '.join(ctes)} {body}"


def u_sql(name: str, source: str, column: str) -> dict[str, str]:
    """Common tables with the parameters of a U score: {name}_e, {name}_m, {name}_s."""
    log = f"ln({column} + 1e-9)"
    return {
        f"{name}_e": f"SELECT coalesce(quantile_cont({column}, 0.01) FILTER (WHERE {column} > 0), 1e-6) AS e FROM {source}",
        f"{name}_m": f"SELECT coalesce(median({log}), 0.0) AS m FROM {source}, {name}_e WHERE {column} >= e",
        f"{name}_s": f"SELECT CASE WHEN median(abs({log} - m)) > 0 THEN 1.4826 * median(abs({log} - m)) ELSE 1.0 END AS s FROM {source}, {name}_e, {name}_m WHERE {column} >= e",
    }


def u_expr(name: str, column: str, missing: str = "NULL") -> str:
    e, m, s = (f"(SELECT {k} FROM {name}_{k})" for k in "ems")
    return f"CASE WHEN {column} IS NULL THEN {missing} WHEN {column} < {e} THEN 0.0 ELSE exp(-0.5 * pow((ln({column} + 1e-9) - {m}) / {s}, 2)) END"


def rank_sql(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


def corr_sql(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


def mean_sql(cols: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0.0)" for c in cols)
    return f"({total}) / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in cols)}, 0)"


def t_p_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t: Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    angle, steps = f"atan(abs({t}) / sqrt(({df})::DOUBLE))", 600
    inside = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos({angle} * i / {steps}.0), ({df}) - 1)))"
    return f"CASE WHEN ({df}) > 0 AND ({t}) IS NOT NULL THEN greatest(0.0, 1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {angle} / {3 * steps} * {inside}) END"


def corr_p_sql(r: str, n: str, lost: int = 0) -> str:
    df = f"({n} - {2 + lost})"
    return f"CASE WHEN {r} IS NULL OR {df} < 1 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 ELSE {t_p_sql(f'{r} * sqrt({df} / (1 - {r} * {r}))', df)} END"


def chi2_p_sql(x: str, df: str) -> str:
    """Upper tail of the chi-square distribution: the series of the lower one."""
    a, h = f"(({df}) / 2.0)", f"(({x}) / 2.0)"
    return f"CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) <= 0 THEN 1.0 WHEN ({x}) > 1400 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 900), lambda k: exp(({a} + k) * ln({h}) - {h} - lgamma({a} + k + 1))))) END"


def norm_p_sql(z: str) -> str:
    return chi2_p_sql(f"pow({z}, 2)", "1")


def adjust_sql(src: str, p: str = "p", pool: str = "") -> str:
    """src with p_bonferroni, p_fdr and the decisions, over each pool (key columns, with a comma behind)."""
    by = f"PARTITION BY {pool}{p} IS NULL"
    m, k = f"count(*) OVER ({by})", f"row_number() OVER ({by} ORDER BY {p})"
    inner = f"SELECT *, CASE WHEN {p} IS NOT NULL THEN least(1.0, {p} * {m}) END AS p_bonferroni, {p} * {m} / {k} AS _q, {k} AS _k FROM {src}"
    return f"SELECT * EXCLUDE (_q, _k, _f), CASE WHEN {p} IS NOT NULL THEN _f END AS p_fdr FROM (SELECT *, least(1.0, min(_q) OVER ({by} ORDER BY _k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS _f FROM ({inner}))"


def mixed_sql(src: str, keys: str, name: str = "mx") -> dict[str, str]:
    """Random-intercept fits on the operator's grid from src (keys, subject, x, y): {name}_full and {name}_loo."""
    terms = {
        "a00": "n / (1 + n * ratio)", "a01": "sx / (1 + n * ratio)", "a11": "sxx - ratio / (1 + n * ratio) * sx * sx", "b0": "sy / (1 + n * ratio)", "b1": "sxy - ratio / (1 + n * ratio) * sx * sy",
        "yy": "syy - ratio / (1 + n * ratio) * sy * sy", "logs": "ln(1 + n * ratio)", "rows": "n", "subjects": "1", "xx": "sxx", "xs": "sx",
    }

    def fit(table: str, by: str) -> str:
        det = "(a00 * a11 - a01 * a01)"
        b0, b1 = f"((a11 * b0 - a01 * b1) / {det})", f"((a00 * b1 - a01 * b0) / {det})"
        var = f"greatest((yy - {b0} * b0 - {b1} * b1) / (rows - 2), 1e-300)"
        crit = f"round((rows - 2) * ln({var}) + logs + ln({det}), 9)"
        return f"SELECT {by}, rows::BIGINT AS n, subjects::BIGINT AS subjects, ratio, {b1} AS beta, sqrt({var} * a00 / {det}) AS se FROM {table} WHERE rows >= 30 AND subjects >= 3 AND xx - xs * xs / rows > 1e-12 AND {det} > 0 QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {crit}, ratio) = 1"

    return {
        f"{name}_c": f"SELECT {keys}, subject, x - avg(x) OVER (PARTITION BY {keys}) AS x, y - avg(y) OVER (PARTITION BY {keys}) AS y FROM {src} WHERE x IS NOT NULL AND y IS NOT NULL",
        f"{name}_s": f"SELECT {keys}, subject, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM {name}_c GROUP BY ALL",
        f"{name}_r": "SELECT 0.0::DOUBLE AS ratio UNION ALL SELECT exp(-14 + i / 10.0::DOUBLE) FROM range(231) t(i)",
        f"{name}_g": f"SELECT {keys}, subject, ratio, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in terms.items())} FROM {name}_s, {name}_r",
        f"{name}_t": f"SELECT {keys}, ratio, {', '.join(f'sum({k}) AS {k}' for k in terms)} FROM {name}_g GROUP BY ALL",
        f"{name}_full": fit(f"{name}_t", keys),
        f"{name}_o": f"SELECT {', '.join('t.' + k.strip() for k in keys.split(','))}, g.subject, t.ratio, {', '.join(f't.{k} - g.{k} AS {k}' for k in terms)} FROM {name}_g g JOIN {name}_t t ON {' AND '.join(f't.{k.strip()} = g.{k.strip()}' for k in [*keys.split(','), 'ratio'])}",
        f"{name}_loo": fit(f"{name}_o", f"{keys}, subject"),
    }


#: (n, w): in how many ways signs of 1 to n give a positive rank sum of 0, 1, ...
WAYS_SQL = "SELECT * FROM (WITH RECURSIVE ways AS (SELECT 0 AS n, [1.0::DOUBLE] AS w UNION ALL SELECT n + 1, list_transform(range(0, len(w) + n + 1), lambda i: coalesce(w[i + 1], 0) + CASE WHEN i > n THEN coalesce(w[i - n], 0) ELSE 0 END) FROM ways WHERE n < 50) SELECT * FROM ways)"


def wilcoxon_p_sql(n: str, w: str, ties: str, tie_term: str) -> str:
    """p of signed ranks; needs the table ways (WAYS_SQL) joined on n."""
    low = f"floor(least({w}, {n} * ({n} + 1) / 2 - {w}))::INT"
    z = f"({w} - {n} * ({n} + 1) / 4.0) / sqrt({n} * ({n} + 1) * (2 * {n} + 1) / 24.0 - {tie_term} / 48.0)"
    return f"CASE WHEN {n} < 3 THEN NULL WHEN {n} <= 50 AND NOT {ties} THEN least(1.0, 2 * list_sum(ways.w[1:{low} + 1]) / pow(2.0, {n})) ELSE {norm_p_sql(z)} END"
