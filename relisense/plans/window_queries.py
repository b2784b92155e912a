"""Window-level study: queries and the SQL they are held against."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relisense.functions.columns import row_mean, rounded
from relisense.functions.keep import keep
from relisense.functions.quantiles import median, quantiles
from relisense.operators import conduct, ranks, windows
from relisense.operators.scores import Monotone, UScore, composite_imputed
from relisense.plans.tables import AUX, CORE, DAY, adjust_sql, corr_p_sql, corr_sql, mean_sql, ratings, signal, u_expr, u_sql, with_sql

PAIRS = {f"{a}_{b}": (f"{a}_mean", f"{b}_mean") for a, b in combinations([*CORE, *AUX], 2)}
#: Shares of the windows with least variability that the sweep leaves out, lags, and least common windows.
SWEEP, LAGS, SHIFTS, COMMON_MIN = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99), 6, 3, 15
TARGETS = ["attention_mean", "acc_mean", "acc_std"]


def cells(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_signal(signal(spark, d), width=DAY)


def features(spark: SparkSession, d: str) -> DataFrame:
    """The wide window table, kept: every statistic below reads it more than once."""
    return keep(windows.window_table(cells(spark, d), CORE, AUX))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """The feature table with stability, coherence over 1 and 5 rows, conduct and composites."""
    f = features(spark, d)
    f = conduct.add_stability(f, [*CORE, "temp"])
    f = conduct.add_conduct_variants(f)
    f = conduct.add_coherence(f, {"S_coher": PAIRS["hr_eda"]}, [1, 5])
    f = composite_imputed(keep(f), "S_estab", "S_coher_1", "S_cond_att_acc", name="score_3")
    f = composite_imputed(f, "S_estab", "S_coher_1", None, name="score_2")
    return keep(composite_imputed(f, "S_estab", "S_coher_5", "S_cond_att_acc", name="score_3_prev5"))


def _r(df: DataFrame, keys: list[str], values: dict[str, str] | list[str]) -> DataFrame:
    values = values if isinstance(values, dict) else {v: v for v in values}
    return df.select(*keys, *[rounded(c).alias(k) for k, c in values.items()])


def window_agg(spark, d):
    return cells(spark, d).select("subject", "channel", "win", rounded("mean").alias("mean"), rounded("std").alias("std"), "n_samples")


def window_multiaxis(spark, d):
    return windows.window_multiaxis(signal(spark, d), width=DAY).select("subject", "channel", "win", rounded("std").alias("std"), "n_samples")


def raw_windows(spark, d):
    s = signal(spark, d)
    start = s.agg(F.min("t")).first()[0]
    raw = windows.raw_windows(s.withColumn("t", F.col("t") - start), width=DAY)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return raw.select("subject", "channel", "win", F.size("samples").alias("n"), F.round(total, 4).alias("total"))


def annotation_windows(spark, d):
    rows = ratings(spark, d).select((F.col("unit") % 50).alias("subject"), "rater", (F.col("unit") * 0.5).alias("seconds"), "valence", "arousal")
    return windows.window_annotation(rows, offset=2.5, width=100.0).select("subject", "rater", "win", "n", rounded("valence").alias("valence"), F.round("arousal", 7).alias("arousal"))


def window_table(spark, d):
    return _r(features(spark, d), ["subject", "win", "hr_n_samples", "eda_n_samples", "bvp_n_samples", "attention_n_samples", "acc_n_samples"], [f"{c}_{v}" for c in [*CORE, *AUX] for v in ("mean", "std")])


def window_table_raters(spark, d):
    r = ratings(spark, d).select((F.col("unit") % 30).alias("subject"), (F.floor(F.col("unit") / 30) % 40 + 19700).alias("win"), "rater", "valence").groupBy("subject", "win", "rater").agg(F.avg("valence").alias("valence"))
    t = windows.window_table(cells(spark, d), CORE, [], r)
    return _r(t, ["subject", "win"], ["hr_mean", "R1_valence", "self_valence", "partner_valence"])


def epoch_seconds(spark, d):
    mixed = signal(spark, d).withColumn("t", F.when(F.col("subject") % 2 == 0, F.col("t") * 1000).otherwise(F.col("t")))
    return windows.epoch_seconds(mixed, ["subject", "channel"]).groupBy("subject", "channel").agg(F.round(F.min("t"), 3).alias("first"), F.round(F.max("t"), 3).alias("last"))


def relative_time(spark, d):
    r = windows.relative_time(signal(spark, d))
    return r.groupBy("subject", windows.window_index("t_rel", DAY).alias("win")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("t_rel"), 3).alias("first"))


def startup_latency(spark, d):
    return windows.startup_latency(signal(spark, d)).select("subject", "channel", F.round("latency", 3).alias("latency"), "n")


def grid_alignment(spark, d):
    s = signal(spark, d)
    pick = lambda c: s.where(F.col("channel") == c).select("subject", "t")
    g = windows.nearest_grid(pick("hr"), pick("eda").distinct(), ["subject"])
    return g.groupBy("subject").agg(F.count("distance").alias("n"), F.round(F.max("distance"), 3).alias("largest"), F.round(F.percentile("distance", F.lit(0.5)), 3).alias("median"))


def rolling_std(spark, d):
    return _r(windows.rolling_std(features(spark, d), ["hr_mean"]), ["subject", "win"], ["hr_mean_rstd"])


def shifted(spark, d):
    return _r(windows.shifted(features(spark, d), "eda_mean", [-2, 1, 3]), ["subject", "win"], ["eda_mean_s-2", "eda_mean_s1", "eda_mean_s3"]).withColumnRenamed("eda_mean_s-2", "eda_mean_lead2")


def centred(spark, d):
    return _r(windows.centred(features(spark, d), ["hr_mean", "acc_mean"]), ["subject", "win"], ["hr_mean_c", "acc_mean_c"])


def coherence_sweep(spark, d):
    f = windows.baseline_coherence(features(spark, d), {"c": PAIRS["hr_eda"]}, [1, 2, 3, 5, 8, 10])
    return _r(f, ["subject", "win"], [f"c_{n}" for n in (1, 2, 3, 5, 8, 10)])


def coherence_pairs(spark, d):
    return _r(windows.baseline_coherence(features(spark, d), PAIRS, [1]), ["subject", "win"], [f"{p}_1" for p in PAIRS])


def _periods(spark, d) -> DataFrame:
    s = signal(spark, d)
    times = s.where("channel = 'acc' and subject < 25").groupBy("subject").agg(F.min("t").alias("start"), F.max("t").alias("end")).withColumn("init", F.lit(0.0))
    return keep(windows.assign_period(features(spark, d), times, DAY))


def period_assignment(spark, d):
    return _periods(spark, d).select("subject", "win", "period", F.col("win_in_period").cast("long").alias("win_in_period"))


def period_summary(spark, d):
    f = windows.drop_first_windows(_periods(spark, d), 1)
    m = f.groupBy("subject").pivot("period", ["pre", "debate"]).agg(F.avg("hr_mean"))
    return _r(m, ["subject"], ["pre", "debate"])


def stability(spark, d):
    f = conduct.add_stability(features(spark, d), [*CORE, "temp"])
    return _r(f, ["subject", "win"], [*[f"{c}_S_estab" for c in CORE], "S_estab"])


def conduct_variants(spark, d):
    f = conduct.add_conduct_variants(features(spark, d))
    return _r(f, ["subject", "win"], ["R_attention", "R_acc_movement", "R_acc_lo", "S_cond_att_acc", "S_cond_att_mono_acc_hi", "S_cond_combined"])


def window_scores(spark, d):
    return _r(scored(spark, d), ["subject", "win"], ["S_estab", "S_coher_1", "S_coher_5", "score_3", "score_2", "score_3_prev5"])


def z_variability(spark, d):
    f = features(spark, d)
    m = UScore.fit(f, {c: f"{c}_std" for c in CORE}, cut=False)
    return _r(f.withColumn("z_var", row_mean([m[c].z(f"{c}_std") for c in CORE])), ["subject", "win"], ["z_var"])


def high_variability_sweep(spark, d):
    """Spearman of z_var with each target, pooled and within subjects, among the windows at or above each quantile of z_var."""
    f = features(spark, d)
    m = UScore.fit(f, {c: f"{c}_std" for c in CORE}, cut=False)
    f = f.withColumn("z", row_mean([m[c].z(f"{c}_std") for c in CORE]))
    q = quantiles(f, {str(p): ("z", p) for p in SWEEP})
    parts = F.array_compact(F.array(*[F.when(F.col("z") >= v, F.lit(float(k))) for k, v in q.items()]))
    rows = ranks.long_pairs(f.withColumn("quantile", F.explode(parts)), {t: ("z", t) for t in TARGETS}, ["quantile", "subject"])
    inner = windows.centred(rows, ["x", "y"], ["quantile", "test", "subject"])
    both = rows.withColumn("kind", F.lit("pooled")).unionByName(inner.select("quantile", "subject", "test", F.col("x_c").alias("x"), F.col("y_c").alias("y"), F.lit("within").alias("kind")))
    return _r(ranks.with_p(ranks.correlations(both, ["quantile", "test", "kind"], digits=9)), ["quantile", "test", "kind", "n"], ["r", "p"])


def median_split(spark, d):
    """Mean targets on either side of the median coherence."""
    f = scored(spark, d)
    m = median(f, "S_coher_1")
    side = F.when(F.col("S_coher_1") >= m, "high").when(F.col("S_coher_1") < m, "low")
    return _r(f.withColumn("side", side).where("side is not null").groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg("attention_mean").alias("attention"), F.avg("acc_mean").alias("acc")), ["side", "n"], ["attention", "acc"])


def component_independence(spark, d):
    f = scored(spark, d)
    legs = {"estab_coher": ("S_estab", "S_coher_1"), "estab_cond": ("S_estab", "S_cond_att_acc"), "coher_cond": ("S_coher_1", "S_cond_att_acc")}
    return _r(ranks.correlations(ranks.long_pairs(f, legs), ["test"], "pearson"), ["test", "n"], ["r"])


def components_vs_targets(spark, d):
    """Spearman of every component with every target; one pool, corrected."""
    f = scored(spark, d)
    metrics = ["S_estab", "S_coher_1", "S_coher_5", "S_cond_att_acc", "score_3"]
    t = ranks.correlations(ranks.long_pairs(f, {f"{m}|{y}": (m, y) for m in metrics for y in TARGETS}), ["test"])
    t = ranks.adjust(ranks.with_p(t)).withColumn("reject_fdr", F.col("reject_fdr").cast("int"))
    return _r(t, ["test", "n", "reject_fdr"], ["r", "p", "p_bonferroni", "p_fdr"])


def leverage(spark, d):
    t = ranks.leverage(features(spark, d), "hr_mean", TARGETS)
    return _r(t, ["target", "n"], ["rho_full", "rho_between", "rho_within", "p_within", "loso_min", "loso_max", "loso_max_delta"])


def lag_sensitivity(spark, d):
    """Pooled and within-subject Spearman of coherence and target with one channel shifted."""
    by = list(range(-SHIFTS, SHIFTS + 1))
    f = windows.shifted(features(spark, d), "eda_mean", by)
    f = windows.baseline_coherence(f, {f"c{k}": ("hr_mean", f"eda_mean_s{k}") for k in by}, [1])
    f = windows.centred(f, [*[f"c{k}_1" for k in by], "attention_mean"])
    tests = {f"{k}|pooled": (f"c{k}_1", "attention_mean") for k in by} | {f"{k}|within": (f"c{k}_1_c", "attention_mean_c") for k in by}
    return _r(ranks.correlations(ranks.long_pairs(f, tests), ["test"], digits=9), ["test", "n"], ["r"])


def cross_correlogram(spark, d):
    """By lag: subjects, mean Spearman correlation, and how many subjects have their strongest one there."""
    t = ranks.cross_correlogram(features(spark, d), "hr_mean", "eda_mean", LAGS, COMMON_MIN)
    per = t.groupBy("lag").agg(F.count("r").alias("subjects"), F.avg("r").alias("mean_r"))
    best = ranks.strongest_lag(t).groupBy("lag").agg(F.count(F.lit(1)).alias("strongest"))
    return _r(per.join(best, "lag", "left").fillna(0, ["strongest"]), ["lag", "subjects", "strongest"], ["mean_r"])


def pair_leverage(spark, d):
    """All ten channel pairs: coherence against each target, pooled and within subjects, corrected over the family."""
    f = windows.baseline_coherence(features(spark, d), PAIRS, [1])
    rows = ranks.long_pairs(f, {f"{p}|{t}": (f"{p}_1", t) for p in PAIRS for t in TARGETS}, ["subject"])
    inner = windows.centred(rows, ["x", "y"], ["test", "subject"]).select("test", F.col("x_c").alias("x"), F.col("y_c").alias("y"))
    within = ranks.adjust(ranks.with_p(ranks.correlations(inner, ["test"], digits=9)))
    full = ranks.correlations(rows.select("test", "x", "y"), ["test"], digits=9).select("test", F.col("r").alias("rho_full"))
    return _r(full.join(within, "test"), ["test", "n"], {"rho_full": "rho_full", "rho_within": "r", "p_within": "p", "p_bonferroni": "p_bonferroni", "p_fdr": "p_fdr"})


def subject_means(spark, d):
    f = features(spark, d)
    return _r(f.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"{c}_mean").alias(c) for c in CORE]), ["subject", "n"], CORE)


def fitted_elsewhere(spark, d):
    """Scores of each half of the subjects by a model fitted on the other half."""
    f = features(spark, d)
    low, high = (UScore.fit(f.where(c), ["hr_std"])["hr_std"] for c in ("subject < 15", "subject >= 15"))
    return _r(f.withColumn("u", F.when(F.col("subject") < 15, high.score("hr_std")).otherwise(low.score("hr_std"))), ["subject", "win"], ["u"])


def monotone_score(spark, d):
    f = features(spark, d)
    m = Monotone.fit(f, {"up": ("attention_mean", 1), "down": ("attention_mean", -1)})
    return _r(f.withColumn("up", m["up"].score("attention_mean")).withColumn("down", m["down"].score("attention_mean")), ["subject", "win"], ["up", "down"])


def _coher_cte(name: str, src: str, a: str, b: str, ns: list[int]) -> dict[str, str]:
    base = ", ".join(f"avg({c}) OVER (PARTITION BY subject ORDER BY win ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS b{i}_{n}" for i, c in enumerate((a, b)) for n in ns)
    std = ", ".join(f"nullif(stddev_samp({c}) OVER (PARTITION BY subject), 0) AS s{i}" for i, c in enumerate((a, b)))
    out = ", ".join(f"exp(-abs(({a} - b0_{n}) / s0 - ({b} - b1_{n}) / s1) / 2) AS c_{n}" for n in ns)
    return {f"{name}_b": f"SELECT *, {base}, {std} FROM {src}", name: f"SELECT *, {out} FROM {name}_b"}


def _mono_cte(name: str, src: str, c: str) -> dict[str, str]:
    return {f"{name}_m": f"SELECT median({c}) AS m FROM {src}", f"{name}_s": f"SELECT 1.4826 * median(abs({c} - m)) AS s FROM {src}, {name}_m"}


def _mono(name: str, c: str, sign: int) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN 1 - exp(-greatest({sign} * ({c} - (SELECT m FROM {name}_m)) / (SELECT s FROM {name}_s), 0.0) / 2) END"


_r6 = lambda cols: ", ".join(f"round({c}, 6) + 0.0 AS {k}" for k, c in (cols.items() if isinstance(cols, dict) else ((c, c) for c in cols)))
_U = {k: v for c in CORE for k, v in u_sql(f"u_{c}", "feat", f"{c}_std").items()}
_ESTAB = mean_sql([f"({u_expr(f'u_{c}', f'{c}_std')})" for c in CORE])
_COND = u_sql("u_at", "feat", "attention_mean") | u_sql("u_mv", "feat", "acc_std")
_CONDX = mean_sql([f"({u_expr('u_at', 'attention_mean')})", f"({u_expr('u_mv', 'acc_std')})"])
_SCORED = _U | _COND | _coher_cte("coh", "feat", "hr_mean", "eda_mean", [1, 5]) | {
    "sc": f"SELECT subject, win, attention_mean, acc_mean, acc_std, {_ESTAB} AS S_estab, c_1 AS S_coher_1, c_5 AS S_coher_5, {_CONDX} AS S_cond_att_acc FROM coh",
    "me": "SELECT median(S_estab) AS me, median(S_coher_1) AS m1, median(S_coher_5) AS m5, median(S_cond_att_acc) AS mc FROM sc",
    "scored": "SELECT *, (coalesce(S_estab, me) + coalesce(S_coher_1, m1) + coalesce(S_cond_att_acc, mc)) / 3.0 AS score_3, (coalesce(S_estab, me) + coalesce(S_coher_1, m1)) / 2.0 AS score_2, (coalesce(S_estab, me) + coalesce(S_coher_5, m5) + coalesce(S_cond_att_acc, mc)) / 3.0 AS score_3_prev5 FROM sc, me",
}
_ZL = {k: v for c in CORE for k, v in {f"z_{c}_m": f"SELECT median(ln({c}_std + 1e-9)) AS m FROM feat", f"z_{c}_s": f"SELECT 1.4826 * median(abs(ln({c}_std + 1e-9) - m)) AS s FROM feat, z_{c}_m"}.items()}
_ZV = mean_sql([f"((ln({c}_std + 1e-9) - (SELECT m FROM z_{c}_m)) / (SELECT s FROM z_{c}_s))" for c in CORE])
_PERIOD = {
    "tm": "SELECT subject, floor(min(t) / 86400.0::DOUBLE) AS w0, floor(max(t) / 86400.0::DOUBLE) AS w1 FROM sig WHERE channel = 'acc' AND subject < 25 GROUP BY subject",
    "per": "SELECT f.*, CASE WHEN w0 IS NULL OR win BETWEEN w0 AND w1 THEN 'debate' ELSE 'pre' END AS period FROM feat f LEFT JOIN tm ON f.subject = tm.subject",
    "perw": "SELECT *, row_number() OVER (PARTITION BY subject, period ORDER BY win) - 1 AS win_in_period FROM per",
}


def _pairs_sql(tests: dict[str, tuple[str, str]], src: str, keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{k}' AS test, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y FROM {src} WHERE ({x}) IS NOT NULL AND ({y}) IS NOT NULL" for k, (x, y) in tests.items())


def _spearman_sql(by: str, src: str = "prs") -> dict[str, str]:
    rank = lambda c: f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0)"
    return {"rk": f"SELECT {by}, {rank('x')} AS rx, {rank('y')} AS ry FROM {src}", "cor": f"SELECT {by}, count(*) AS n, {corr_sql('rx', 'ry')} AS r FROM rk GROUP BY {by}"}


_LEV = {
    "prs": _pairs_sql({t: ("hr_mean", t) for t in TARGETS}, "feat", "subject, "),
    "mns": "SELECT test, subject, avg(x) AS mx, avg(y) AS my FROM prs GROUP BY ALL",
    "all_": "SELECT test, 'full' AS kind, -1 AS excl, x, y FROM prs UNION ALL SELECT test, 'between', -1, mx, my FROM mns UNION ALL SELECT p.test, 'within', -1, x - mx, y - my FROM prs p JOIN mns m ON p.test = m.test AND p.subject = m.subject UNION ALL SELECT p.test, 'loso', m.subject, x, y FROM prs p JOIN mns m ON p.test = m.test AND p.subject <> m.subject",
    **_spearman_sql("test, kind, excl", "all_"),
    "ful": "SELECT test, n, r FROM cor WHERE kind = 'full'",
}
_LEVERAGE = {
    "rho_full": "any_value(f.r)", "rho_between": "max(c.r) FILTER (kind = 'between')", "rho_within": "max(c.r) FILTER (kind = 'within')", "loso_min": "min(c.r) FILTER (kind = 'loso')",
    "loso_max": "max(c.r) FILTER (kind = 'loso')", "loso_max_delta": "max(abs(c.r - f.r)) FILTER (kind = 'loso')",
}
_WTABLE = [f"{c}_{v}" for c in [*CORE, *AUX] for v in ("mean", "std")]
_BY = range(-SHIFTS, SHIFTS + 1)
_name = lambda k: f"m{-k}" if k < 0 else f"p{k}"
_LAG = {"sh": "SELECT *, " + ", ".join(f"{'lead' if k < 0 else 'lag'}(eda_mean, {abs(k)}) OVER w AS s{_name(k)}" for k in _BY) + " FROM feat WINDOW w AS (PARTITION BY subject ORDER BY win)"}
for _k in _BY:
    _LAG |= _coher_cte(f"lg_{_name(_k)}", "sh", "hr_mean", f"s{_name(_k)}", [1])
    _LAG[f"lc_{_name(_k)}"] = f"SELECT c_1, attention_mean, round(c_1 - avg(c_1) OVER (PARTITION BY subject), 9) AS cc, round(attention_mean - avg(attention_mean) OVER (PARTITION BY subject), 9) AS ac FROM lg_{_name(_k)}"
_LAG["prs"] = " UNION ALL ".join(_pairs_sql({f"{k}|pooled": ("round(c_1, 9)", "round(attention_mean, 9)"), f"{k}|within": ("cc", "ac")}, f"lc_{_name(k)}") for k in _BY)
_TEN = {k: v for p, (a, b) in PAIRS.items() for k, v in _coher_cte(f"w_{p}", "feat", a, b, [1]).items()}
_CENTRE = lambda by: f"SELECT {by}, round(x - avg(x) OVER (PARTITION BY {by}, subject), 9) AS x, round(y - avg(y) OVER (PARTITION BY {by}, subject), 9) AS y FROM raw"
_PAIRED = _TEN | {
    "raw": " UNION ALL ".join(_pairs_sql({f"{p}|{t}": ("c_1", t) for t in TARGETS}, f"w_{p}", "subject, ") for p in PAIRS), "cen": _CENTRE("test"),
    "tog": "SELECT test, 'full' AS kind, round(x, 9) AS x, round(y, 9) AS y FROM raw UNION ALL SELECT test, 'within', x, y FROM cen", **_spearman_sql("test, kind", "tog"),
}
_SWEEP = _ZL | {
    "zv": f"SELECT *, {_ZV} AS z FROM feat", "qs": "SELECT unnest([" + ", ".join(map(str, SWEEP)) + "])::DOUBLE AS q, unnest([" + ", ".join(f"quantile_cont(z, {q})" for q in SWEEP) + "]) AS t FROM zv", "zq": "SELECT q, zv.* FROM zv JOIN qs ON z >= t",
    "raw": _pairs_sql({t: ("z", t) for t in TARGETS}, "zq", "q, subject, "), "cen": _CENTRE("q, test"), "tog": "SELECT q, test, 'pooled' AS kind, round(x, 9) AS x, round(y, 9) AS y FROM raw UNION ALL SELECT q, test, 'within', x, y FROM cen", **_spearman_sql("q, test, kind", "tog"),
}

QUERIES = {
    "window_agg": (window_agg, with_sql(["cells"], f"SELECT subject, channel, win, {_r6(['mean', 'std'])}, n_samples FROM cells")),
    "window_multiaxis": (window_multiaxis, with_sql(["sig"], "SELECT subject, channel, win, round(avg(s), 6) + 0.0 AS std, max(n) AS n_samples FROM ax GROUP BY ALL", {"ax": "SELECT subject, channel, axis, floor(t / 86400.0::DOUBLE)::BIGINT AS win, stddev_samp(value) AS s, count(*) AS n FROM sig GROUP BY ALL"})),
    "raw_windows": (raw_windows, with_sql(["sig"], "SELECT s.subject, s.channel, s.win, coalesce(n, 0) AS n, round(coalesce(total, 0.0), 4) AS total FROM spine s LEFT JOIN got g ON s.subject = g.subject AND s.channel = g.channel AND s.win = g.win", {"got": "SELECT subject, channel, floor((t - (SELECT min(t) FROM sig)) / 86400.0::DOUBLE)::BIGINT AS win, count(*) AS n, sum(value) AS total FROM sig GROUP BY ALL", "spine": "SELECT subject, channel, unnest(range(0, max(win) + 1)) AS win FROM got GROUP BY subject, channel"})),
    "annotation_windows": (annotation_windows, with_sql(["rat"], "SELECT unit % 50 AS subject, rater, floor((unit * 0.5::DOUBLE + 2.5) / 100.0::DOUBLE)::BIGINT AS win, count(*) AS n, round(avg(valence), 6) + 0.0 AS valence, round(avg(arousal), 7) AS arousal FROM rat GROUP BY ALL")),
    "window_table": (window_table, with_sql(["feat"], f"SELECT subject, win, hr_n_samples, eda_n_samples, bvp_n_samples, attention_n_samples, acc_n_samples, {_r6(_WTABLE)} FROM feat")),
    "window_table_raters": (window_table_raters, with_sql(["feat", "rat"], f"SELECT f.subject, f.win, {_r6({'hr_mean': 'hr_mean', 'R1_valence': 'r1', 'self_valence': 's', 'partner_valence': 'p'})} FROM feat f LEFT JOIN rw ON f.subject = rw.subject AND f.win = rw.win", {"rc": "SELECT unit % 30 AS subject, unit // 30 % 40 + 19700 AS win, rater, avg(valence) AS v FROM rat GROUP BY ALL", "rw": "SELECT subject, win, max(v) FILTER (rater = 'R1') AS r1, max(v) FILTER (rater = 'self') AS s, max(v) FILTER (rater = 'partner') AS p FROM rc GROUP BY ALL"})),
    "epoch_seconds": (epoch_seconds, with_sql(["sig"], "SELECT subject, channel, round(min(t), 3) AS first, round(max(t), 3) AS last FROM sig GROUP BY ALL")),
    "relative_time": (relative_time, with_sql(["sig"], "SELECT s.subject, floor((t - t0) / 86400.0::DOUBLE)::BIGINT AS win, count(*) AS n, round(min(t - t0), 3) AS first FROM sig s JOIN z ON s.subject = z.subject GROUP BY ALL", {"f": "SELECT subject, channel, arg_min(t, pos) AS f FROM sig GROUP BY ALL", "z": "SELECT subject, min(f) AS t0 FROM f GROUP BY ALL"})),
    "startup_latency": (startup_latency, with_sql(["sig"], "SELECT f.subject, channel, round(f - t0, 3) AS latency, n FROM f JOIN z ON f.subject = z.subject", {"f": "SELECT subject, channel, arg_min(t, pos) AS f, count(*) AS n FROM sig GROUP BY ALL", "z": "SELECT subject, min(f) AS t0 FROM f GROUP BY ALL"})),
    "grid_alignment": (grid_alignment, with_sql(["sig"], "SELECT subject, count(*) AS n, round(max(x), 3) AS largest, round(median(x), 3) AS median FROM nd GROUP BY subject", {"nd": "SELECT a.subject, a.pos, min(abs(a.t - b.t)) AS x FROM sig a JOIN sig b ON a.subject = b.subject WHERE a.channel = 'hr' AND b.channel = 'eda' GROUP BY ALL"})),
    "rolling_std": (rolling_std, with_sql(["feat"], "SELECT subject, win, round(CASE WHEN count(hr_mean) OVER w >= 3 THEN stddev_samp(hr_mean) OVER w END, 6) + 0.0 AS hr_mean_rstd FROM feat WINDOW w AS (PARTITION BY subject ORDER BY win ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")),
    "shifted": (shifted, with_sql(["feat"], f"SELECT subject, win, {_r6({'eda_mean_lead2': 'lead(eda_mean, 2) OVER w', 'eda_mean_s1': 'lag(eda_mean, 1) OVER w', 'eda_mean_s3': 'lag(eda_mean, 3) OVER w'})} FROM feat WINDOW w AS (PARTITION BY subject ORDER BY win)")),
    "centred": (centred, with_sql(["feat"], f"SELECT subject, win, {_r6({'hr_mean_c': 'hr_mean - avg(hr_mean) OVER w', 'acc_mean_c': 'acc_mean - avg(acc_mean) OVER w'})} FROM feat WINDOW w AS (PARTITION BY subject)")),
    "coherence_sweep": (coherence_sweep, with_sql(["feat"], f"SELECT subject, win, {_r6([f'c_{n}' for n in (1, 2, 3, 5, 8, 10)])} FROM c", _coher_cte("c", "feat", "hr_mean", "eda_mean", [1, 2, 3, 5, 8, 10]))),
    "coherence_pairs": (coherence_pairs, with_sql(["feat"], "SELECT f.subject, f.win, " + ", ".join(f"round(w_{p}.c_1, 6) + 0.0 AS {p}_1" for p in PAIRS) + " FROM feat f " + " ".join(f"JOIN w_{p} ON w_{p}.subject = f.subject AND w_{p}.win = f.win" for p in PAIRS), _TEN)),
    "period_assignment": (period_assignment, with_sql(["feat"], "SELECT subject, win, period, win_in_period FROM perw", _PERIOD)),
    "period_summary": (period_summary, with_sql(["feat"], "SELECT subject, round(avg(hr_mean) FILTER (period = 'pre'), 6) + 0.0 AS pre, round(avg(hr_mean) FILTER (period = 'debate'), 6) + 0.0 AS debate FROM perw WHERE win_in_period >= 1 GROUP BY subject", _PERIOD)),
    "stability": (stability, with_sql(["feat"], f"SELECT subject, win, {_r6({f'{c}_S_estab': u_expr(f'u_{c}', f'{c}_std') for c in CORE} | {'S_estab': _ESTAB})} FROM feat", _U)),
    "conduct_variants": (conduct_variants, with_sql(["feat"], f"SELECT subject, win, {_r6({'R_attention': 'a', 'R_acc_movement': 'm', 'R_acc_lo': 'lo', 'S_cond_att_acc': mean_sql(['a', 'm']), 'S_cond_att_mono_acc_hi': mean_sql(['am', 'hi']), 'S_cond_combined': mean_sql(['a', 'm'])})} FROM v", _COND | _mono_cte("ma", "feat", "attention_mean") | _mono_cte("mm", "feat", "acc_std") | {"v": f"SELECT subject, win, {u_expr('u_at', 'attention_mean')} AS a, {u_expr('u_mv', 'acc_std')} AS m, {_mono('mm', 'acc_std', -1)} AS lo, {_mono('mm', 'acc_std', 1)} AS hi, {_mono('ma', 'attention_mean', 1)} AS am FROM feat"})),
    "window_scores": (window_scores, with_sql(["feat"], f"SELECT subject, win, {_r6(['S_estab', 'S_coher_1', 'S_coher_5', 'score_3', 'score_2', 'score_3_prev5'])} FROM scored", _SCORED)),
    "z_variability": (z_variability, with_sql(["feat"], f"SELECT subject, win, round({_ZV}, 6) + 0.0 AS z_var FROM feat", _ZL)),
    "high_variability_sweep": (high_variability_sweep, with_sql(["feat"], "SELECT q AS quantile, test, kind, n, " + _r6({"r": "r", "p": corr_p_sql("r", "n")}) + " FROM cor WHERE n >= 10", _SWEEP)),
    "pair_leverage": (pair_leverage, with_sql(["feat"], "SELECT a.test, b.n, " + _r6({"rho_full": "a.r", "rho_within": "b.r", "p_within": "p", "p_bonferroni": "p_bonferroni", "p_fdr": "p_fdr"}) + " FROM cor a JOIN adj b ON a.test = b.test AND a.kind = 'full' WHERE a.n >= 10", _PAIRED | {"tst": f"SELECT test, n, r, {corr_p_sql('r', 'n')} AS p FROM cor WHERE kind = 'within' AND n >= 10", "adj": adjust_sql("tst")})),
    "median_split": (median_split, with_sql(["feat"], "SELECT CASE WHEN S_coher_1 >= m1 THEN 'high' ELSE 'low' END AS side, count(*) AS n, round(avg(attention_mean), 6) + 0.0 AS attention, round(avg(acc_mean), 6) + 0.0 AS acc FROM scored WHERE S_coher_1 IS NOT NULL GROUP BY 1", _SCORED)),
    "component_independence": (component_independence, with_sql(["feat"], f"SELECT test, count(*) AS n, round({corr_sql('x', 'y')}, 6) + 0.0 AS r FROM prs GROUP BY test", _SCORED | {"prs": _pairs_sql({"estab_coher": ("S_estab", "S_coher_1"), "estab_cond": ("S_estab", "S_cond_att_acc"), "coher_cond": ("S_coher_1", "S_cond_att_acc")}, "scored")})),
    "components_vs_targets": (components_vs_targets, with_sql(["feat"], "SELECT test, n, " + _r6(["r", "p", "p_bonferroni", "p_fdr"]) + ", (p_fdr <= 0.05)::INT AS reject_fdr FROM adj", _SCORED | {"prs": _pairs_sql({f"{m}|{y}": (m, y) for m in ("S_estab", "S_coher_1", "S_coher_5", "S_cond_att_acc", "score_3") for y in TARGETS}, "scored")} | _spearman_sql("test") | {"tst": f"SELECT test, n, r, {corr_p_sql('r', 'n')} AS p FROM cor WHERE n >= 10", "adj": adjust_sql("tst")})),
    "leverage": (leverage, with_sql(["feat"], f"SELECT target, n, {_r6([*_LEVERAGE])}, {_r6({'p_within': corr_p_sql('rho_within', 'n')})} FROM lv", _LEV | {"lv": f"SELECT f.test AS target, any_value(f.n) AS n, {', '.join(f'{v} AS {k}' for k, v in _LEVERAGE.items())} FROM ful f JOIN cor c ON f.test = c.test GROUP BY f.test"})),
    "lag_sensitivity": (lag_sensitivity, with_sql(["feat"], "SELECT test, n, round(r, 6) + 0.0 AS r FROM cor WHERE n >= 10", _LAG | _spearman_sql("test"))),
    "cross_correlogram": (cross_correlogram, with_sql(["feat"], "SELECT c.lag, count(r) AS subjects, coalesce(any_value(k), 0) AS strongest, round(avg(r), 6) + 0.0 AS mean_r FROM en c LEFT JOIN (SELECT lag, count(*) AS k FROM bl GROUP BY lag) b ON b.lag = c.lag GROUP BY c.lag", {"ps": "SELECT subject, hr_mean, eda_mean, row_number() OVER (PARTITION BY subject ORDER BY win) AS p FROM feat WHERE hr_mean IS NOT NULL AND eda_mean IS NOT NULL", "lg": f"SELECT unnest(range({-LAGS}, {LAGS + 1})) AS lag", "prs": f"SELECT h.subject, lag, h.hr_mean AS x, e.eda_mean AS y FROM ps h CROSS JOIN lg JOIN ps e ON e.subject = h.subject AND h.p = e.p + lag WHERE h.subject IN (SELECT subject FROM ps GROUP BY subject HAVING count(*) >= {COMMON_MIN})"} | _spearman_sql("subject, lag") | {"en": "SELECT * FROM cor WHERE n >= 10", "bl": "SELECT subject, arg_max(lag, (round(abs(r), 9), -lag)) AS lag FROM en WHERE r IS NOT NULL GROUP BY subject"})),
    "subject_means": (subject_means, with_sql(["feat"], f"SELECT subject, count(*) AS n, {_r6({c: f'avg({c}_mean)' for c in CORE})} FROM feat GROUP BY subject")),
    "fitted_elsewhere": (fitted_elsewhere, with_sql(["feat"], f"SELECT subject, win, round(CASE WHEN subject < 15 THEN {u_expr('rhi', 'hr_std')} ELSE {u_expr('rlo', 'hr_std')} END, 6) + 0.0 AS u FROM feat", {"lo": "SELECT * FROM feat WHERE subject < 15", "hi": "SELECT * FROM feat WHERE subject >= 15"} | u_sql("rlo", "lo", "hr_std") | u_sql("rhi", "hi", "hr_std"))),
    "monotone_score": (monotone_score, with_sql(["feat"], f"SELECT subject, win, {_r6({'up': _mono('ma', 'attention_mean', 1), 'down': _mono('ma', 'attention_mean', -1)})} FROM feat", _mono_cte("ma", "feat", "attention_mean"))),
}
