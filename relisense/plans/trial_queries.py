"""Trial- and item-level study, labels, quality rules: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from relisense.functions.columns import first_present, rounded
from relisense.functions.keep import keep
from relisense.functions.spread import spread
from relisense.operators import conduct, labels, quality, ranks, variance
from relisense.operators.scores import ClassicZ, Monotone, UScore, imputed, plausibility_gate, plausible_share
from relisense.plans.tables import EXTERNAL, corr_sql, mean_sql, rank_sql, ratings, table, trials, u_expr, u_sql, with_sql
from relisense.plans.window_queries import _mono, _mono_cte, _pairs_sql, _r, _r6, _spearman_sql

METRICS = ["hr", "pupil", "rt", "blinks"]
STABILITY = {"estab_hr": "hr_std", "estab_et": "pupil_std"}


def _kept_trials(spark, d, *columns):
    """Trials with some of their columns, made once: every pass of a fit reads them."""
    return keep(trials(spark, d).select("item", "subject", *columns))


def scored_trials(spark, d):
    """Trials with their scores as expressions over the kept trials, whose files hold an item's trials together."""
    t = conduct.trial_scores(keep(trials(spark, d, "item")), STABILITY, "rt", "blinks")  # every fit reads it
    t = t.withColumn("S_estab", (F.col("S_estab_hr") + F.col("S_estab_et")) / 2)
    t = conduct.trial_coherence(t, ("hr", "hr_base"), ("pupil", "pupil_base"))
    return conduct.trial_composite(t)


def items(spark, d, *metrics):
    """(item, n, legs, composite), and the mean and deviation of the metrics that are named."""
    legs = ("S_estab_hr", "S_estab_et", "S_coher", "S_cond")
    per = scored_trials(spark, d).groupBy("item").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in (*legs, *metrics)], *[F.stddev_samp(c).alias(f"{c}_sd") for c in metrics])
    return conduct.item_composite(keep(per), ["S_estab_hr", "S_estab_et"], "S_coher", "S_cond")  # medians of the legs read it


def order_labels(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("label"), F.when(F.col("o_orderstatus") == "F", "YES").when(F.col("o_orderstatus") == "O", "NO").otherwise(F.col("o_orderstatus")).alias("status"))


def dealt_labels(spark, d):
    """The labels with an item's together, in parts that don't grow with the table."""
    return spread(order_labels(spark, d), "item")


def trial_scores(spark, d):
    return _r(scored_trials(spark, d), ["item", "subject"], ["S_estab_hr", "S_estab_et", "S_cond", "S_coher", "score"])


def trial_variants(spark, d):
    """Monotone reaction leg, and missing deviations left missing."""
    t = _kept_trials(spark, d, *STABILITY.values(), "rt", "blinks")
    a = conduct.trial_scores(t, STABILITY, "rt", "blinks", reaction_form="mono", null_policy="null")
    return _r(a, ["item", "subject"], ["S_estab_hr", "S_cond"])


def item_scores(spark, d):
    return _r(items(spark, d, "hr"), ["item", "n"], ["S_estab", "S_coher", "S_cond", "score", "hr", "hr_sd"])


def two_leg(spark, d):
    return _r(conduct.two_leg(items(spark, d), "S_estab_imputed", "S_coher_imputed", "two"), ["item"], ["two"])


def item_classes(spark, d):
    """Kruskal-Wallis of the composite by the hard label; effect size and medians."""
    lab = labels.label_entropy(dealt_labels(spark, d), "item")
    rows = items(spark, d).join(lab.select("item", "hard"), "item").select(F.lit("score").alias("metric"), "hard", "score")
    return _r(ranks.kruskal(rows, ["metric"], "hard", "score"), ["metric", "n", "k"], ["h", "eps2"])


def class_medians(spark, d):
    lab = labels.binary_entropy(dealt_labels(spark, d), "item", "status")
    rows = items(spark, d).join(lab.select("item", "hard"), "item").withColumn("metric", F.lit("score"))
    return _r(ranks.group_medians(rows, ["metric"], "hard", "score"), ["metric", "hard", "n"], ["median"])


def item_correlations(spark, d):
    """Pearson grid: rows complete in all metrics and the target."""
    lab = labels.label_entropy(dealt_labels(spark, d), "item").select("item", "entropy")
    rows = items(spark, d).join(lab, "item").dropna(subset=["S_estab", "S_coher", "S_cond", "score", "entropy"])
    pairs = ranks.long_pairs(rows, {m: (m, "entropy") for m in ("S_estab", "S_coher", "S_cond", "score")})
    return _r(ranks.correlations(pairs, ["test"], "pearson"), ["test", "n"], ["r"])


def item_spearman(spark, d):
    lab = labels.label_entropy(dealt_labels(spark, d), "item").select("item", "entropy")
    pairs = ranks.long_pairs(items(spark, d, "hr").join(lab, "item"), {m: (m, "entropy") for m in ("S_estab", "S_coher", "S_cond", "score", "hr")})
    return _r(ranks.correlations(pairs, ["test"], digits=9), ["test", "n"], ["r"])


def partial_correlation(spark, d):
    """Partial Spearman with one control, over items' means; no score enters, so none is fitted."""
    rows = keep(trials(spark, d, "item").groupBy("item").agg(*[F.avg(c).alias(c) for c in ("hr", "pupil", "rt")])).withColumn("one", F.lit("all"))
    return _r(ranks.partial_spearman(rows, ["one"], "hr", "pupil", ["rt"], digits=9), ["one", "n"], ["r"])


def multiple_testing(spark, d):
    """Corrections over a pool of values in (0, 1), one per part brand."""
    p = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 60).alias("test")).agg(F.try_divide(F.sum("l_tax"), F.sum("l_discount")).alias("q"))
    p = p.withColumn("p", F.pow(F.lit(10.0), -3 * F.col("q")) * (F.col("test") + 1) / 4).withColumn("p", F.when(F.col("test") != 7, F.col("p")))
    return ranks.adjust(p).select("test", rounded("p_bonferroni").alias("p_bonferroni"), rounded("p_fdr").alias("p_fdr"), F.col("reject_fdr").cast("int").alias("reject_fdr"))


def icc(spark, d):
    t = trials(spark, d).withColumn("metric", F.lit("hr"))
    return _r(variance.one_way_icc(t, ["metric"], "item", "hr"), ["metric", "k", "n"], ["n0", "msb", "msw", "icc"])


def variance_components(spark, d):
    t = variance.power_bound(variance.variance_decomposition(keep(trials(spark, d)), METRICS))
    return _r(t, ["metric", "rows", "items"], ["icc_subject", "icc_item", "icc_item_centred", "k", "item_reliability", "r_min"])


def _few_viewers(spark, d):
    """Trials with few viewers an item: every order line, the order as item and the return flag as viewer."""
    lines = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "item", "l_returnflag": "subject"})
    return spread(lines, "item", "subject").groupBy("item", "subject").agg(F.avg("l_quantity").alias("hr"), F.avg("l_extendedprice").alias("pupil"), F.avg("l_discount").alias("rt"), F.avg("l_tax").alias("blinks"))


def _two_sources(spark, d):
    """Trials from lines of either status: two sources that share some pairs; no line is left out."""
    lines = table(spark, d, "lineitem").withColumnsRenamed({"l_partkey": "item", "l_suppkey": "subject"})
    rows = spread(lines, "item", "subject").groupBy("item", "subject", "l_linestatus").agg(F.avg("l_quantity").alias("hr"))
    return [rows.where(F.col("l_linestatus") == x).drop("l_linestatus") for x in ("F", "O")]


def viewer_pairs(spark, d):
    return _r(variance.viewer_pairs(_few_viewers(spark, d), ["hr", "rt"], digits=9), ["metric", "a", "b", "n"], ["r"])


def pooled_pairs(spark, d):
    return _r(variance.pooled_pairs(variance.viewer_pairs(_few_viewers(spark, d), ["hr", "rt"], digits=9)), ["metric", "pairs"], ["r_median", "r_iqr", "r_pool", "reliability"])


def dispersion(spark, d):
    return variance.dispersion(trials(spark, d, "item"), METRICS).select("item", *[rounded(F.col(m) + 1e-10, 8).alias(m) for m in METRICS])


def label_entropies(spark, d):
    return _r(labels.label_entropy(dealt_labels(spark, d), "item"), ["item", "n", "hard"], ["entropy"])


def binary_labels(spark, d):
    return _r(labels.binary_entropy(dealt_labels(spark, d), "item", "status"), ["item", "n", "hard"], ["p_yes", "entropy"])


def nested_labels(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    nested = table(spark, d, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("item")).agg(F.collect_list("flags").alias("lists"))
    return _r(labels.label_entropy(labels.flattened(nested, "item", "lists"), "item"), ["item", "n", "hard"], ["entropy"])


def rater_statistics(spark, d):
    r = labels.rater_statistics(ratings(spark, d), ["unit"], "valence", EXTERNAL)
    return _r(r, ["unit", "valence_n_valid"], ["valence_mean", "valence_var", "valence_range", "valence_self_partner_diff", "valence_self_external_diff"])


def viewer_groups(spark, d):
    return labels.viewer_groups(_few_viewers(spark, d))


def coverage_structure(spark, d):
    return _r(labels.coverage_structure(_few_viewers(spark, d)), ["items", "one", "two", "most", "groups"], ["mean", "median"])


def source_overlap(spark, d):
    a, b = _two_sources(spark, d)
    r = labels.source_overlap(a, b, order_labels(spark, d))
    return _r(r, ["pairs_a", "pairs_b", "pairs_both", "items_a", "items_b", "items_both", "items_labelled", "items_unlabelled"], ["pairs_share_a", "pairs_share_b", "label_share"])


def common_keys(spark, d):
    a, b = quality.common_keys(*_two_sources(spark, d))
    n = lambda df, k: df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("items")).select(F.lit(k).alias("side"), "n", "items")
    return n(a, "a").unionByName(n(b, "b"))


def set_operations(spark, d):
    """Union, intersection and difference of two pair sets."""
    a, b = (t.select("item", "subject") for t in _two_sources(spark, d))
    n = lambda df, k: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("item") * 31 + F.col("subject")).alias("sum")).select(F.lit(k).alias("op"), "n", "sum")
    return n(a.union(b).distinct(), "union").unionByName(n(a.intersect(b), "intersect")).unionByName(n(a.subtract(b), "except"))


def first_per_key(spark, d):
    """The first row of each item by subject, without a window over the item."""
    t = trials(spark, d)
    return t.groupBy("item").agg(F.min("subject").alias("subject"), F.min_by("hr", "subject").alias("hr")).select("item", "subject", rounded("hr").alias("hr"))


def parse_fraction(spark, d):
    p = table(spark, d, "part")
    k, x = F.col("p_partkey"), F.round(F.col("p_retailprice") / 10000, 4)
    cell = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, F.concat(k.cast("string"), F.lit(" ("), x.cast("string"), F.lit(")"))).when(k % 5 == 2, F.lit("")).when(k % 5 == 3, F.lit("broken")).otherwise(x.cast("string"))
    return p.select("p_partkey", rounded(quality.parse_fraction(cell)).alias("fraction"))


def eligible_subjects(spark, d):
    c = table(spark, d, "customer")
    flags = c.select("c_custkey", (F.col("c_acctbal") > 0).alias("self"), (F.col("c_nationkey") > 4).alias("partner"), *[(F.col("c_custkey") % (i + 1) == 0).alias(f"R{i}") for i in range(1, 6)])
    return quality.eligible(flags, ["self", "partner"], EXTERNAL, 3).select("c_custkey")


def _quality_table(spark, d):
    c = table(spark, d, "customer")
    v = lambda k, m: F.when(F.col("c_custkey") % 11 != m, F.pmod(F.col("c_custkey") * k, F.lit(100)) / 100.0)
    return c.select(F.col("c_custkey").alias("subject"), (v(7, 1) + 0.2).alias("completeness_a"), (v(13, 2) + 0.5).alias("completeness_b"), (v(3, 3) / 3).alias("zeros_a"), (v(17, 4) / 4).alias("zeros_b"), (v(19, 5) / 8).alias("outliers_a"), (v(23, 6) / 9).alias("outliers_b"), (v(29, 7) + 0.3).alias("durations_a"), (v(31, 8) + 0.3).alias("durations_b"))


def low_quality(spark, d):
    return quality.low_quality(_quality_table(spark, d), ["a", "b"])


def filtered_features(spark, d):
    t = _quality_table(spark, d)
    f = t.select("subject", F.when(F.col("subject") % 4 != 0, F.col("zeros_a")).alias("a_mean"), F.when(F.col("subject") % 6 != 0, F.col("zeros_b")).alias("b_mean"))
    return quality.filter_features(f, quality.low_quality(t, ["a", "b"]).where("reason = 'zeros'")).select("subject", rounded("a_mean").alias("a_mean"), rounded("b_mean").alias("b_mean"))


def duplicate_keys(spark, d):
    return quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumnRenamed("count", "n")


def null_channels(spark, d):
    t = trials(spark, d)
    return quality.null_channels(t, ["hr_std", "pupil_std"], ["rt", "blinks"]).select("n", "all_null", "rt_present", "blinks_present")


def coverage(spark, d):
    return _r(quality.coverage(trials(spark, d), ["hr", "hr_std", "pupil_std"], ["subject"]), ["subject", "n"], ["hr", "hr_std", "pupil_std"])


def describe(spark, d):
    return _r(quality.describe(trials(spark, d), ["hr", "rt", "blinks"]), ["column", "n"], ["mean", "std", "min", "max", "zero_share", "q5", "q50", "q95"])


def out_of_range(spark, d):
    return quality.out_of_range(trials(spark, d), ["rt", "hr"], 0.0, 1.0).select("column", F.col("outside").cast("int").alias("outside"))


def imputation(spark, d):
    return _r(imputed(_kept_trials(spark, d, "hr_std"), ["hr_std"]), ["item", "subject"], ["hr_std_imputed"])


def gate(spark, d):
    return _r(trials(spark, d).withColumn("g", plausibility_gate("hr", F.round(F.col("rt") * 10, 6))), ["item", "subject"], ["g"])


def plausible_shares(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_list("l_quantity").alias("s"))
    return t.select("unit", rounded(plausible_share("s", 10.0, 35.0, 2)).alias("share"))


def classic_z(spark, d):
    t = _kept_trials(spark, d, "hr_std")
    return _r(t.withColumn("u", ClassicZ.fit(t, "hr_std").score("hr_std")), ["item", "subject"], ["u"])


def mono_decay(spark, d):
    t = _kept_trials(spark, d, "hr_std")
    return _r(t.withColumn("u", UScore.fit(t, ["hr_std"])["hr_std"].score("hr_std", shape="mono")), ["item", "subject"], ["u"])


def value_column(spark, d):
    t = trials(spark, d).withColumnRenamed("hr", "bpm")
    return t.select("item", "subject", rounded(first_present(t, ["value", "bpm", "hr", "HR"])).alias("value"))


def column_groups(spark, d):
    """Row means over columns chosen by name."""
    from relisense.functions.columns import row_mean

    t = trials(spark, d)
    return t.select("item", "subject", rounded(row_mean(quality.columns_like(t, suffix="_std"))).alias("std"), rounded(row_mean(quality.columns_like(t, prefix="hr", suffix="base"))).alias("base"))


def json_labels(spark, d):
    """Counts by the value of a JSON field."""
    e = table(spark, d, "events").select(F.from_json("props", "map<string,bigint>").alias("m")).select(F.explode("m").alias("key", "value"))
    return e.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def reaction_monotone(spark, d):
    t = _kept_trials(spark, d, "rt")
    return _r(t.withColumn("m", Monotone.fit(t, {"m": ("rt", -1)})["m"].score("rt")), ["item", "subject"], ["m"])


def mean_abs_dispersion_tests(spark, d):
    t = trials(spark, d, "item")
    g = variance.dispersion(t, ["hr", "rt"]).join(labels.label_entropy(dealt_labels(spark, d), "item").select("item", "entropy"), "item")
    return _r(ranks.correlations(ranks.long_pairs(g, {m: (m, "entropy") for m in ("hr", "rt")}), ["test"], least=30, digits=9), ["test", "n"], ["r"])


_UT = {k: v for n, c in (("uh", "hr_std"), ("up", "pupil_std"), ("ur", "rt"), ("ub", "blinks")) for k, v in u_sql(n, "tri", c).items()}
_TRIAL = _UT | {
    "sd": "SELECT subject, nullif(stddev_samp(hr), 0) AS sa, nullif(stddev_samp(pupil), 0) AS sb FROM tri GROUP BY subject",
    "ts": f"SELECT t.*, {u_expr('uh', 'hr_std', '1.0')} AS S_estab_hr, {u_expr('up', 'pupil_std', '1.0')} AS S_estab_et, (({u_expr('ur', 'rt', '1.0')}) + ({u_expr('ub', 'blinks', '1.0')})) / 2 AS S_cond, exp(-abs((hr - hr_base) / sa - (pupil - pupil_base) / sb) / 2) AS S_coher FROM tri t JOIN sd ON t.subject = sd.subject",
    "tsc": "SELECT *, ((S_estab_hr + S_estab_et) / 2 + S_coher + S_cond) / 3.0 AS score FROM ts",
    "im": "SELECT item, count(*) AS n, avg(S_estab_hr) AS a, avg(S_estab_et) AS b, avg(S_coher) AS S_coher, avg(S_cond) AS S_cond, avg(hr) AS hr, avg(pupil) AS pupil, avg(rt) AS rt, stddev_samp(hr) AS hr_sd FROM ts GROUP BY item",
    "im2": "SELECT *, (a + b) / 2 AS S_estab FROM im",
    "itm": "SELECT *, (coalesce(S_estab, (SELECT median(S_estab) FROM im2)) + coalesce(S_coher, (SELECT median(S_coher) FROM im2)) + coalesce(S_cond, (SELECT median(S_cond) FROM im2))) / 3.0 AS score FROM im2",
}
_LAB = "SELECT o_custkey AS item, o_orderpriority AS label, CASE o_orderstatus WHEN 'F' THEN 'YES' WHEN 'O' THEN 'NO' ELSE o_orderstatus END AS status FROM orders"


def _entropy(src: str, name: str = "ent") -> dict[str, str]:
    return {f"{name}_c": f"SELECT item, label, count(*)::DOUBLE AS c FROM {src} GROUP BY ALL", f"{name}_t": f"SELECT item, sum(c) AS n, max(c) AS m FROM {name}_c GROUP BY item", name: f"SELECT t.item, t.n::BIGINT AS n, -sum(c / n * ln(c / n)) AS entropy, min(label) FILTER (c = m) AS hard FROM {name}_c c JOIN {name}_t t ON c.item = t.item GROUP BY t.item, t.n"}


_ENT = {"lab": _LAB} | _entropy("lab")
_BIN = {"lab": _LAB, "bn": "SELECT item, count(*) AS n, avg((status = 'YES')::INT) AS py, avg((status = 'NO')::INT) AS pn FROM lab GROUP BY item", "bin": "SELECT item, n, py AS p_yes, (CASE WHEN py > 0 THEN -py * ln(py) ELSE 0 END) + (CASE WHEN pn > 0 THEN -pn * ln(pn) ELSE 0 END) AS entropy, CASE WHEN py >= 0.5 THEN 'YES' ELSE 'NO' END AS hard FROM bn"}


def _icc(name: str, src: str, group: str, v: str) -> dict[str, str]:
    return {
        f"{name}_g": f"SELECT metric, {group} AS g, count(*)::DOUBLE AS m, avg({v}) AS a, var_pop({v}) * count(*) AS w FROM {src} WHERE {v} IS NOT NULL GROUP BY ALL",
        f"{name}_m": f"SELECT metric, sum(m * a) / sum(m) AS gm FROM {name}_g GROUP BY metric",
        f"{name}_t": f"SELECT g.metric, count(*) AS k, sum(m) AS n, sum(m * (a - gm) ** 2) / (count(*) - 1) AS msb, sum(w) / (sum(m) - count(*)) AS msw, (sum(m) - sum(m * m) / sum(m)) / (count(*) - 1) AS n0 FROM {name}_g g JOIN {name}_m m ON g.metric = m.metric GROUP BY g.metric",
        name: f"SELECT metric, k, n, n0, msb, msw, ((msb - msw) / n0) / ((msb - msw) / n0 + msw) AS icc FROM {name}_t",
    }


_LONG = {"lng": " UNION ALL ".join(f"SELECT '{m}' AS metric, item, subject, {m} AS v FROM tri WHERE {m} IS NOT NULL" for m in METRICS), "lc": "SELECT metric, item, subject, v - avg(v) OVER (PARTITION BY metric, subject) AS v FROM lng"}
_FEW = {"few": "SELECT l_orderkey AS item, l_returnflag AS subject, avg(l_quantity) AS hr, avg(l_extendedprice) AS pupil, avg(l_discount) AS rt, avg(l_tax) AS blinks FROM lineitem GROUP BY ALL"}
_TWO = "WITH " + ", ".join(f"{k} AS (SELECT l_partkey AS item, l_suppkey AS subject FROM lineitem WHERE l_linestatus = '{x}' GROUP BY ALL)" for k, x in (("sa", "F"), ("sb", "O"))) + ", sc AS (SELECT * FROM sa INTERSECT SELECT * FROM sb), "
_TWO += ", ".join(f"i{k} AS (SELECT DISTINCT item FROM s{k})" for k in "ab") + ", ic AS (SELECT item FROM ia INTERSECT SELECT item FROM ib) "
_VP = _FEW | {
    "vl": "SELECT 'hr' AS metric, item, subject, hr - avg(hr) OVER (PARTITION BY subject) AS v FROM few UNION ALL SELECT 'rt', item, subject, rt - avg(rt) OVER (PARTITION BY subject) FROM few",
    "v2": "SELECT metric, item FROM vl GROUP BY ALL HAVING count(*) = 2",
    "prs": "SELECT a.metric, a.subject AS a, b.subject AS b, round(a.v, 9) AS x, round(b.v, 9) AS y FROM vl a JOIN vl b ON a.metric = b.metric AND a.item = b.item AND a.subject < b.subject JOIN v2 ON v2.metric = a.metric AND v2.item = a.item",
    **_spearman_sql("metric, a, b"), "vp": "SELECT * FROM cor WHERE n >= 20",
}
_QT = {
    "qt": "SELECT c_custkey AS subject, "
    + ", ".join(f"CASE WHEN c_custkey % 11 <> {m} THEN (c_custkey * {k} % 100) / 100.0::DOUBLE END {op} AS {n}" for n, k, m, op in (("completeness_a", 7, 1, "+ 0.2"), ("completeness_b", 13, 2, "+ 0.5"), ("zeros_a", 3, 3, "/ 3"), ("zeros_b", 17, 4, "/ 4"), ("outliers_a", 19, 5, "/ 8"), ("outliers_b", 23, 6, "/ 9"), ("durations_a", 29, 7, "+ 0.3"), ("durations_b", 31, 8, "+ 0.3")))
    + " FROM customer",
    "lq": "SELECT subject, 'completeness' AS reason FROM qt WHERE completeness_a < 0.9 OR completeness_b < 0.9 UNION ALL SELECT subject, 'zeros' FROM qt WHERE zeros_a > 0.2 OR zeros_b > 0.2 UNION ALL SELECT subject, 'outliers' FROM qt WHERE outliers_a > 0.1 OR outliers_b > 0.1 UNION ALL SELECT subject, 'durations' FROM qt WHERE least(durations_a, durations_b) / greatest(durations_a, durations_b) < 0.5",
}
_SCORE4 = ("S_estab", "S_coher", "S_cond", "score")
_KW = {"kr": "SELECT hard, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM kin", "ks": "SELECT hard, sum(r) AS s, count(*) AS m FROM kr GROUP BY hard", "kt": "SELECT sum(t) AS n, sum(t ** 3 - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM kin GROUP BY score)", "kh": "SELECT n, (SELECT count(*) FROM ks) AS k, (12.0 / (n * (n + 1)) * (SELECT sum(s * s / m) FROM ks) - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h FROM kt"}

QUERIES = {
    "trial_scores": (trial_scores, with_sql(["tri"], f"SELECT item, subject, {_r6(['S_estab_hr', 'S_estab_et', 'S_cond', 'S_coher', 'score'])} FROM tsc", _TRIAL)),
    "trial_variants": (trial_variants, with_sql(["tri"], f"SELECT item, subject, {_r6({'S_estab_hr': u_expr('uh', 'hr_std'), 'S_cond': '((' + _mono('mr', 'rt', -1) + ') + (' + u_expr('ub', 'blinks') + ')) / 2'})} FROM tri", _UT | _mono_cte("mr", "tri", "rt"))),
    "item_scores": (item_scores, with_sql(["tri"], f"SELECT item, n, {_r6([*_SCORE4, 'hr', 'hr_sd'])} FROM itm", _TRIAL)),
    "two_leg": (two_leg, with_sql(["tri"], "SELECT item, round((coalesce(S_estab, (SELECT median(S_estab) FROM im2)) + coalesce(S_coher, (SELECT median(S_coher) FROM im2))) / 2.0, 6) + 0.0 AS two FROM itm", _TRIAL)),
    "item_classes": (item_classes, with_sql(["tri"], "SELECT 'score' AS metric, n::BIGINT AS n, k, round(h, 6) + 0.0 AS h, round((h - k + 1) / (n - k), 6) + 0.0 AS eps2 FROM kh", _TRIAL | _ENT | {"kin": "SELECT hard, score FROM itm JOIN ent ON itm.item = ent.item WHERE hard IN (SELECT hard FROM itm JOIN ent ON itm.item = ent.item GROUP BY hard HAVING count(*) >= 2)"} | _KW)),
    "class_medians": (class_medians, with_sql(["tri"], "SELECT 'score' AS metric, hard, count(*) AS n, round(median(score), 6) + 0.0 AS median FROM itm JOIN bin ON itm.item = bin.item GROUP BY hard", _TRIAL | _BIN)),
    "item_correlations": (item_correlations, with_sql(["tri"], f"SELECT test, count(*) AS n, round({corr_sql('x', 'y')}, 6) + 0.0 AS r FROM prs GROUP BY test", _TRIAL | _ENT | {"ie": "SELECT itm.*, entropy FROM itm JOIN ent ON itm.item = ent.item WHERE S_estab IS NOT NULL AND S_coher IS NOT NULL AND S_cond IS NOT NULL", "prs": _pairs_sql({m: (m, "entropy") for m in _SCORE4}, "ie")})),
    "item_spearman": (item_spearman, with_sql(["tri"], "SELECT test, n, round(r, 6) + 0.0 AS r FROM cor", _TRIAL | _ENT | {"ie": "SELECT itm.*, entropy FROM itm JOIN ent ON itm.item = ent.item", "prs": _pairs_sql({m: (f"round({m}, 9)", "round(entropy, 9)") for m in (*_SCORE4, "hr")}, "ie")} | _spearman_sql("test"))),
    "partial_correlation": (partial_correlation, with_sql(["tri"], f"SELECT 'all' AS one, n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) + 0.0 AS r FROM (SELECT count(*) AS n, {corr_sql('x', 'y')} AS xy, {corr_sql('x', 'z')} AS xz, {corr_sql('y', 'z')} AS yz FROM pr)", _TRIAL | {"pr": f"SELECT {rank_sql('round(hr, 9)', '1')} AS x, {rank_sql('round(pupil, 9)', '1')} AS y, {rank_sql('round(rt, 9)', '1')} AS z FROM itm"})),
    "multiple_testing": (multiple_testing, "WITH q AS (SELECT l_partkey % 60 AS test, sum(l_tax) / sum(l_discount) AS q FROM lineitem GROUP BY 1), p AS (SELECT test, CASE WHEN test <> 7 THEN pow(10.0, -3 * q) * (test + 1) / 4 END AS p FROM q), k AS (SELECT test, p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM p WHERE p IS NOT NULL), f AS (SELECT test, least(1.0, p * m) AS b, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS f FROM k) SELECT p.test, round(b, 6) + 0.0 AS p_bonferroni, round(f, 6) + 0.0 AS p_fdr, (f <= 0.05)::INT AS reject_fdr FROM p LEFT JOIN f ON p.test = f.test"),
    "icc": (icc, with_sql(["tri"], f"SELECT metric, k, n::BIGINT AS n, {_r6(['n0', 'msb', 'msw', 'icc'])} FROM ic", {"hrl": "SELECT 'hr' AS metric, item, hr FROM tri"} | _icc("ic", "hrl", "item", "hr"))),
    "variance_components": (variance_components, with_sql(["tri"], f"SELECT s.metric, nr AS rows, ni AS items, {_r6({'icc_subject': 's.icc', 'icc_item': 'i.icc', 'icc_item_centred': 'c.icc', 'k': 'nr / ni', 'item_reliability': '(nr / ni) * greatest(c.icc, 0) / (1 + (nr / ni - 1) * greatest(c.icc, 0))', 'r_min': '(1.959964 + 0.8416212) / sqrt(nr / (1 + (nr / ni - 1) * greatest(c.icc, 0)))'})} FROM sic s JOIN iic i ON s.metric = i.metric JOIN cic c ON c.metric = i.metric JOIN nn ON nn.metric = s.metric", _LONG | _icc("sic", "lng", "subject", "v") | _icc("iic", "lng", "item", "v") | _icc("cic", "lc", "item", "v") | {"nn": "SELECT metric, count(*) AS nr, count(DISTINCT item) AS ni FROM lng GROUP BY metric"})),
    "viewer_pairs": (viewer_pairs, with_sql(["tri"], "SELECT metric, a, b, n, round(r, 6) + 0.0 AS r FROM vp", _VP)),
    "pooled_pairs": (pooled_pairs, with_sql(["tri"], f"SELECT metric, pairs, {_r6(['r_median', 'r_iqr', 'r_pool'])}, round(2 * r_pool / (1 + r_pool), 6) + 0.0 AS reliability FROM pp", _VP | {"pp": "SELECT metric, count(*) AS pairs, median(r) AS r_median, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS r_iqr, tanh(sum((n - 3) * atanh(greatest(least(r, 0.999), -0.999))) / sum(n - 3)) AS r_pool FROM vp WHERE r IS NOT NULL GROUP BY metric"})),
    "dispersion": (dispersion, with_sql(["tri"], f"SELECT item, {', '.join(f'round(CASE WHEN count({m}) >= 2 THEN avg(abs({m} - a_{m})) END + 1e-10, 8) + 0.0 AS {m}' for m in METRICS)} FROM ds WHERE v >= 2 GROUP BY item", {"dm": f"SELECT item, count(DISTINCT subject) AS v, {', '.join(f'avg({m}) AS a_{m}' for m in METRICS)} FROM tri GROUP BY item", "ds": "SELECT tri.*, v, a_hr, a_pupil, a_rt, a_blinks FROM tri JOIN dm ON tri.item = dm.item"})),
    "label_entropies": (label_entropies, f"WITH {', '.join(f'{k} AS ({v})' for k, v in _ENT.items())} SELECT item, n, hard, round(entropy, 6) + 0.0 AS entropy FROM ent"),
    "binary_labels": (binary_labels, f"WITH {', '.join(f'{k} AS ({v})' for k, v in _BIN.items())} SELECT item, n, hard, round(p_yes, 6) + 0.0 AS p_yes, round(entropy, 6) + 0.0 AS entropy FROM bin"),
    "nested_labels": (nested_labels, f"WITH nl AS (SELECT o_custkey AS item, l_returnflag AS label FROM orders JOIN lineitem ON o_orderkey = l_orderkey), {', '.join(f'{k} AS ({v})' for k, v in _entropy('nl').items())} SELECT item, n, hard, round(entropy, 6) + 0.0 AS entropy FROM ent"),
    "rater_statistics": (rater_statistics, with_sql(["rat"], f"SELECT unit, count(e) AS valence_n_valid, {_r6({'valence_mean': 'avg(e)', 'valence_var': 'var_samp(e)', 'valence_range': 'max(e) - min(e)', 'valence_self_partner_diff': 'abs(avg(s) - avg(p))', 'valence_self_external_diff': 'abs(avg(s) - avg(e))'})} FROM (SELECT unit, CASE WHEN rater LIKE 'R_' THEN valence END AS e, CASE WHEN rater = 'self' THEN valence END AS s, CASE WHEN rater = 'partner' THEN valence END AS p FROM rat) GROUP BY unit")),
    "viewer_groups": (viewer_groups, with_sql(["tri"], "SELECT item, string_agg(DISTINCT subject::VARCHAR, '|' ORDER BY subject::VARCHAR) AS viewers FROM few GROUP BY item", _FEW)),
    "coverage_structure": (coverage_structure, with_sql(["tri"], "SELECT count(*) AS items, count(*) FILTER (v = 1) AS one, count(*) FILTER (v = 2) AS two, max(v) AS most, count(DISTINCT CASE WHEN v >= 2 THEN who END) AS groups, round(avg(v), 6) + 0.0 AS mean, round(median(v), 6) + 0.0 AS median FROM (SELECT item, count(DISTINCT subject) AS v, string_agg(DISTINCT subject::VARCHAR, '|' ORDER BY subject::VARCHAR) AS who FROM few GROUP BY item)", _FEW)),
    "source_overlap": (source_overlap, _TWO + "SELECT *, round(pairs_both / pairs_a, 6) + 0.0 AS pairs_share_a, round(pairs_both / pairs_b, 6) + 0.0 AS pairs_share_b, round(items_labelled / items_both, 6) + 0.0 AS label_share FROM (SELECT (SELECT count(*) FROM sa) AS pairs_a, (SELECT count(*) FROM sb) AS pairs_b, (SELECT count(*) FROM sc) AS pairs_both, (SELECT count(*) FROM ia) AS items_a, (SELECT count(*) FROM ib) AS items_b, (SELECT count(*) FROM ic) AS items_both, (SELECT count(*) FROM ic WHERE item IN (SELECT o_custkey FROM orders)) AS items_labelled, (SELECT count(*) FROM ic WHERE item NOT IN (SELECT o_custkey FROM orders)) AS items_unlabelled)"),
    "common_keys": (common_keys, _TWO + "SELECT 'a' AS side, count(*) AS n, count(DISTINCT item) AS items FROM sa WHERE item IN (SELECT item FROM ic) UNION ALL SELECT 'b', count(*), count(DISTINCT item) FROM sb WHERE item IN (SELECT item FROM ic)"),
    "set_operations": (set_operations, _TWO + " UNION ALL ".join(f"SELECT '{o}' AS op, count(*) AS n, sum(item * 31 + subject)::BIGINT AS sum FROM (SELECT * FROM sa {o.upper()} SELECT * FROM sb)" for o in ("union", "intersect", "except"))),
    "first_per_key": (first_per_key, with_sql(["tri"], "SELECT item, min(subject) AS subject, round(arg_min(hr, subject), 6) + 0.0 AS hr FROM tri GROUP BY item")),
    "parse_fraction": (parse_fraction, "SELECT p_partkey, round(CASE WHEN p_partkey % 5 IN (1, 4) THEN round(p_retailprice / 10000, 4) END, 6) + 0.0 AS fraction FROM part"),
    "eligible_subjects": (eligible_subjects, "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey > 4 AND (c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 4 = 0)::INT + (c_custkey % 5 = 0)::INT + (c_custkey % 6 = 0)::INT >= 3"),
    "low_quality": (low_quality, f"WITH {', '.join(f'{k} AS ({v})' for k, v in _QT.items())} SELECT subject, reason FROM lq"),
    "filtered_features": (filtered_features, f"WITH {', '.join(f'{k} AS ({v})' for k, v in _QT.items())} SELECT * FROM (SELECT subject, round(CASE WHEN subject % 4 <> 0 THEN zeros_a END, 6) + 0.0 AS a_mean, round(CASE WHEN subject % 6 <> 0 THEN zeros_b END, 6) + 0.0 AS b_mean FROM qt WHERE subject NOT IN (SELECT subject FROM lq WHERE reason = 'zeros')) WHERE a_mean IS NOT NULL OR b_mean IS NOT NULL"),
    "duplicate_keys": (duplicate_keys, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "null_channels": (null_channels, with_sql(["tri"], "SELECT count(*) AS n, count(*) FILTER (hr_std IS NULL AND pupil_std IS NULL) AS all_null, count(rt) FILTER (hr_std IS NULL AND pupil_std IS NULL) AS rt_present, count(blinks) FILTER (hr_std IS NULL AND pupil_std IS NULL) AS blinks_present FROM tri")),
    "coverage": (coverage, with_sql(["tri"], f"SELECT subject, count(*) AS n, {_r6({c: f'count({c}) / count(*)' for c in ('hr', 'hr_std', 'pupil_std')})} FROM tri GROUP BY subject")),
    "describe": (describe, with_sql(["tri"], " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, {_r6({'mean': f'avg({c})', 'std': f'stddev_samp({c})', 'min': f'min({c})', 'max': f'max({c})', 'zero_share': f'avg(({c} = 0)::INT)', 'q5': f'quantile_cont({c}, 0.05)', 'q50': f'median({c})', 'q95': f'quantile_cont({c}, 0.95)'})} FROM tri" for c in ("hr", "rt", "blinks")))),
    "out_of_range": (out_of_range, with_sql(["tri"], "SELECT 'rt' AS \"column\", bool_or(rt < 0 OR rt > 1)::INT AS outside FROM tri UNION ALL SELECT 'hr', bool_or(hr < 0 OR hr > 1)::INT FROM tri")),
    "imputation": (imputation, with_sql(["tri"], "SELECT item, subject, round(coalesce(hr_std, (SELECT median(hr_std) FROM tri)), 6) + 0.0 AS hr_std_imputed FROM tri")),
    "gate": (gate, with_sql(["tri"], "SELECT item, subject, round(CASE WHEN round(rt * 10, 6) < 0.5 THEN 0.0 ELSE hr END, 6) + 0.0 AS g FROM tri")),
    "plausible_shares": (plausible_shares, "SELECT l_orderkey AS unit, round(CASE WHEN count(*) >= 2 THEN avg((l_quantity BETWEEN 10 AND 35)::INT) END, 6) + 0.0 AS share FROM lineitem GROUP BY 1"),
    "classic_z": (classic_z, with_sql(["tri"], "SELECT item, subject, round(CASE WHEN hr_std < (SELECT e FROM uh_e) THEN 0.0 WHEN hr_std IS NOT NULL THEN exp(-0.5 * pow((ln(hr_std + 1e-9) - (SELECT a FROM cz)) / (SELECT s FROM cz), 2)) END, 6) + 0.0 AS u FROM tri", u_sql("uh", "tri", "hr_std") | {"cz": "SELECT avg(ln(hr_std + 1e-9)) AS a, stddev_pop(ln(hr_std + 1e-9)) AS s FROM tri, uh_e WHERE hr_std >= e"})),
    "mono_decay": (mono_decay, with_sql(["tri"], "SELECT item, subject, round(CASE WHEN hr_std < (SELECT e FROM uh_e) THEN 0.0 WHEN hr_std IS NOT NULL THEN 1 / (1 + abs((ln(hr_std + 1e-9) - (SELECT m FROM uh_m)) / (SELECT s FROM uh_s))) END, 6) + 0.0 AS u FROM tri", u_sql("uh", "tri", "hr_std"))),
    "value_column": (value_column, with_sql(["tri"], "SELECT item, subject, round(hr, 6) + 0.0 AS value FROM tri")),
    "column_groups": (column_groups, with_sql(["tri"], f"SELECT item, subject, round({mean_sql(['hr_std', 'pupil_std'])}, 6) + 0.0 AS std, round(hr_base, 6) + 0.0 AS base FROM tri")),
    "json_labels": (json_labels, "SELECT 'k' AS key, (props->>'k')::BIGINT AS value, count(*) AS n FROM events GROUP BY ALL"),
    "reaction_monotone": (reaction_monotone, with_sql(["tri"], f"SELECT item, subject, round({_mono('mr', 'rt', -1)}, 6) + 0.0 AS m FROM tri", _mono_cte("mr", "tri", "rt"))),
    "dispersion_tests": (mean_abs_dispersion_tests, with_sql(["tri"], "SELECT test, n, round(r, 6) + 0.0 AS r FROM cor", _ENT | {"dm": "SELECT item, count(DISTINCT subject) AS v, avg(hr) AS ah, avg(rt) AS ar FROM tri GROUP BY item", "dd": "SELECT tri.item, avg(abs(hr - ah)) AS hr, avg(abs(rt - ar)) AS rt FROM tri JOIN dm ON tri.item = dm.item WHERE v >= 2 GROUP BY tri.item", "de": "SELECT dd.*, entropy FROM dd JOIN ent ON dd.item = ent.item", "prs": _pairs_sql({m: (f"round({m}, 9)", "round(entropy, 9)") for m in ("hr", "rt")}, "de")} | _spearman_sql("test"))),
}
