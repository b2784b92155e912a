"""Whole families of tests of the window study, corrected, with the SQL they are held against.

The disagreement of raters is that of ``ratings``, laid over the windows; every family is one
keyed job over a long table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from relisense.functions.columns import row_mean, rounded
from relisense.functions.keep import keep
from relisense.functions.quantiles import median, quantiles
from relisense.operators import conduct, labels, models, ranks, windows
from relisense.operators.scores import UScore, imputed
from relisense.plans.record_queries import _LOO
from relisense.plans.tables import AUX, CORE, EXTERNAL, WAYS_SQL, adjust_sql, corr_p_sql, mean_sql, mixed_sql, norm_p_sql, ratings, wilcoxon_p_sql, with_sql
from relisense.plans.window_queries import _CENTRE, _PERIOD, _SCORED, _TEN, _ZL, _ZV, PAIRS, _mono, _mono_cte, _pairs_sql, _periods, _r, _r6, _spearman_sql, features, scored

#: The five measures of disagreement.
DISAGREEMENT = ["valence_var", "valence_range", "arousal_var", "valence_self_partner_diff", "valence_self_external_diff"]
TASK_COLUMNS = [f"{c}_{v}" for c in [*CORE, *AUX] for v in ("mean", "std")]


def disagreement(spark, d):
    """(subject, win, the five measures): raters of all units that fall on a window, averaged per rater first."""
    r = ratings(spark, d).select((F.col("unit") % 30).alias("subject"), (F.floor(F.col("unit") / 30) % 40 + 19700).alias("win"), "rater", "valence", "arousal")
    r = keep(r.groupBy("subject", "win", "rater").agg(F.avg("valence").alias("valence"), F.avg("arousal").alias("arousal")))
    v, a = (labels.rater_statistics(r, ["subject", "win"], c, EXTERNAL) for c in ("valence", "arousal"))
    return v.join(a.select("subject", "win", "arousal_var"), ["subject", "win"]).select("subject", "win", *DISAGREEMENT)


def rated(spark, d):
    """The scored windows with the raters' disagreement."""
    return keep(scored(spark, d).join(disagreement(spark, d), ["subject", "win"], "left"))


def _tested(t):
    """n, r, p and the corrections of a pool."""
    t = ranks.adjust(ranks.with_p(t))
    return t.select("test", "n", *[rounded(c).alias(c) for c in ("r", "p", "p_bonferroni", "p_fdr")], *[F.col(c).cast("int").alias(c) for c in ("reject_bonferroni", "reject_fdr")])


def _family(df, tests):
    return _tested(ranks.correlations(ranks.long_pairs(df, tests), ["test"], digits=9))


def composite_family(spark, d):
    """The composites against every measure of disagreement, corrected as one block of 15 tests."""
    f = rated(spark, d)
    return _family(f, {f"{s}|{t}": (s, t) for s in ("score_3", "score_2", "score_3_prev5") for t in DISAGREEMENT})


def component_family(spark, d):
    """Every leg and variant against every measure of disagreement; imputed where the composite imputes."""
    f = rated(spark, d)
    f = imputed(f, ["S_estab", "S_coher_1", "S_coher_5"])
    legs = ["S_estab_imputed", "S_coher_1_imputed", "S_coher_5_imputed", *[f"S_cond_{v}" for v in conduct.VARIANTS]]
    return _family(f, {f"{x}|{t}": (x, t) for x in legs for t in DISAGREEMENT})


def pair_family(spark, d):
    """Ten channel pairs against five measures of disagreement: pooled, between and within subjects, without each
    subject, and corrected by the p within subjects."""
    f = windows.baseline_coherence(features(spark, d), PAIRS, [1])
    f = keep(imputed(f, [f"{p}_1" for p in PAIRS]).join(disagreement(spark, d), ["subject", "win"], "left"))
    t = ranks.leverage_of(f, {f"{p}|{t}": (f"{p}_1_imputed", t) for p in PAIRS for t in DISAGREEMENT}, digits=9)
    t = ranks.adjust(t, p="p_within").withColumn("reject_fdr", F.col("reject_fdr").cast("int"))
    return _r(t, ["test", "n", "most_influential", "reject_fdr"], ["rho_full", "rho_between", "rho_within", "p_within", "p_bonferroni", "p_fdr", "loso_min", "loso_max", "loso_max_delta"])


def moderator_split(spark, d):
    """Among the windows in the upper quarter of variability: variability against disagreement within subjects, alone
    and with movement held, on either side of the median coherence."""
    f = rated(spark, d)
    m = UScore.fit(f, {c: f"{c}_std" for c in CORE}, cut=False)
    f = f.withColumn("z", row_mean([m[c].z(f"{c}_std") for c in CORE]))
    high = keep(f.where(F.col("z") >= quantiles(f, {"q": ("z", 0.75)})["q"]))
    at = median(high, "S_coher_1")
    side = F.when(F.col("S_coher_1") >= at, "high").when(F.col("S_coher_1") < at, "low")
    rows = keep(ranks.long_pairs(high.withColumn("side", side).where("side is not null"), {t: ("z", t) for t in DISAGREEMENT}, ["side", "subject", "acc_std"]))
    inner = windows.centred(rows, ["x", "y"], ["side", "test", "subject"]).select("side", "test", F.col("x_c").alias("x"), F.col("y_c").alias("y"))
    alone = ranks.with_p(ranks.correlations(inner, ["side", "test"], digits=9))
    held = windows.centred(rows.where("acc_std is not null"), ["x", "y", "acc_std"], ["side", "test", "subject"]).select("side", "test", *[F.col(f"{c}_c").alias(c) for c in ("x", "y", "acc_std")])
    held = ranks.with_p(ranks.partial_spearman(held, ["side", "test"], "x", "y", ["acc_std"], digits=9), lost=1)
    out = alone.join(held.select("side", "test", F.col("n").alias("n_held"), F.col("r").alias("r_held"), F.col("p").alias("p_held")), ["side", "test"], "left")
    return _r(out, ["side", "test", "n", "n_held"], ["r", "p", "r_held", "p_held"])


def task_validity(spark, d):
    """Every channel's contrast of the two periods."""
    t = models.task_validity(_periods(spark, d), TASK_COLUMNS).withColumns({c: F.col(c).cast("int") for c in ("converged", "sign_flip")})
    counts = ["n", "subjects", "converged", "sign_flip", *[f"wilcoxon_{c}" for c in ("n", "positive", "negative")]]
    return _r(t, ["column", *counts], ["beta", "se", "p", "icc", "loso_min", "loso_max", "loso_max_delta", "wilcoxon_w_plus", "wilcoxon_p", "wilcoxon_median_diff", "wilcoxon_mean_diff", "coverage_pre", "coverage_debate", "beta_drop1", "beta_drop2"])


_ext = lambda c: f"CASE WHEN rater LIKE 'R_' THEN {c} END"
_own = lambda r: f"avg(CASE WHEN rater = '{r}' THEN valence END)"
_DIS = {
    "rw": "SELECT unit % 30 AS subject, unit // 30 % 40 + 19700 AS win, rater, avg(valence) AS valence, avg(arousal) AS arousal FROM rat GROUP BY ALL",
    "dis": f"SELECT subject, win, var_samp({_ext('valence')}) AS valence_var, max({_ext('valence')}) - min({_ext('valence')}) AS valence_range, var_samp({_ext('arousal')}) AS arousal_var, abs({_own('self')} - {_own('partner')}) AS valence_self_partner_diff, abs({_own('self')} - avg({_ext('valence')})) AS valence_self_external_diff FROM rw GROUP BY subject, win",
}
_R9 = lambda tests: {k: (f"round({x}, 9)", f"round({y}, 9)") for k, (x, y) in tests.items()}
_POOL = {"tst": f"SELECT test, n, r, {corr_p_sql('r', 'n')} AS p FROM cor WHERE n >= 10", "adj": adjust_sql("tst")}
_TESTED = "SELECT test, n, " + _r6(["r", "p", "p_bonferroni", "p_fdr"]) + ", (p_bonferroni <= 0.05)::INT AS reject_bonferroni, (p_fdr <= 0.05)::INT AS reject_fdr FROM adj"
_RATED = _SCORED | _DIS | {"rtd": "SELECT s.*, dis.* EXCLUDE (subject, win) FROM scored s LEFT JOIN dis ON dis.subject = s.subject AND dis.win = s.win"}
_u = lambda c: f"(SELECT exp(-0.5 * pow((ln({c} + 1e-9) - m) / s, 2)))"


def _lo_sql(kind: str) -> str:
    return f"FILTER (kind = '{kind}')"


_LEVERAGE = {
    "mns": "SELECT test, subject, avg(x) AS mx, avg(y) AS my FROM prs GROUP BY ALL",
    "all_": "SELECT test, 'full' AS kind, -1 AS excl, round(x, 9) AS x, round(y, 9) AS y FROM prs UNION ALL SELECT test, 'between', -1, round(mx, 9), round(my, 9) FROM mns UNION ALL SELECT p.test, 'within', -1, round(x - mx, 9), round(y - my, 9) FROM prs p JOIN mns m ON p.test = m.test AND p.subject = m.subject UNION ALL SELECT p.test, 'loso', m.subject, round(x, 9), round(y, 9) FROM prs p JOIN mns m ON p.test = m.test AND p.subject <> m.subject",
    **_spearman_sql("test, kind, excl", "all_"),
    "ful": "SELECT test, n, r FROM cor WHERE kind = 'full' AND n >= 10",
    "lev": f"SELECT f.test, any_value(f.n) AS n, any_value(f.r) AS rho_full, max(c.r) {_lo_sql('between')} AS rho_between, max(c.r) {_lo_sql('within')} AS rho_within, min(c.r) {_lo_sql('loso')} AS loso_min, max(c.r) {_lo_sql('loso')} AS loso_max, max(abs(c.r - f.r)) {_lo_sql('loso')} AS loso_max_delta, arg_max(c.excl, round(abs(c.r - f.r), 9) * 1e12 + c.excl) {_lo_sql('loso')} AS most_influential FROM ful f JOIN cor c ON f.test = c.test GROUP BY f.test",
    "tst": f"SELECT *, {corr_p_sql('rho_within', 'n')} AS p_within FROM lev", "adj": adjust_sql("tst", "p_within"),
}
_partial = "(rxy - rxc * ryc) / sqrt((1 - rxc * rxc) * (1 - ryc * ryc))"
_MOD = _ZL | {
    "zr": f"SELECT rtd.*, {_ZV.replace('_std', '_std')} AS z FROM rtf rtd", "hi": "SELECT * FROM zr WHERE z >= (SELECT quantile_cont(z, 0.75) FROM zr)", "sd": "SELECT *, CASE WHEN S_coher_1 >= (SELECT median(S_coher_1) FROM hi) THEN 'high' ELSE 'low' END AS side FROM hi WHERE S_coher_1 IS NOT NULL",
    "raw": " UNION ALL ".join(f"SELECT side, subject, acc_std AS c, '{t}' AS test, z AS x, {t} AS y FROM sd WHERE {t} IS NOT NULL" for t in DISAGREEMENT),
    "prs": "SELECT side, test, round(x - avg(x) OVER w, 9) AS x, round(y - avg(y) OVER w, 9) AS y FROM raw WHERE x IS NOT NULL WINDOW w AS (PARTITION BY side, test, subject)", **_spearman_sql("side, test"),
    "hc": "SELECT side, test, round(x - avg(x) OVER w, 9) AS x, round(y - avg(y) OVER w, 9) AS y, round(c - avg(c) OVER w, 9) AS c FROM raw WHERE c IS NOT NULL WINDOW w AS (PARTITION BY side, test, subject)",
    "hk": "SELECT side, test, " + ", ".join(f"rank() OVER (PARTITION BY side, test ORDER BY {v}) + (count(*) OVER (PARTITION BY side, test, {v}) - 1) / 2.0 AS {v}" for v in "xyc") + " FROM hc",
    "hr": f"SELECT side, test, n_held, {_partial} AS r_held FROM (SELECT side, test, count(*) AS n_held, corr(x, y) AS rxy, corr(x, c) AS rxc, corr(y, c) AS ryc FROM hk GROUP BY side, test) WHERE n_held >= 10",
}
_TASK = _PERIOD | {
    "long": " UNION ALL ".join(f"SELECT '{c}' AS col, subject, period, win_in_period AS w, (period = 'debate')::INT AS x, {c} AS y FROM perw" for c in TASK_COLUMNS),
    "src": "SELECT k, col, subject, x, y FROM long, range(3) t(k) WHERE w >= k", **mixed_sql("src", "k, col"),
    "lo": _LOO["lo"].replace("SELECT col", "SELECT k, col").replace("USING (col)", "USING (k, col)").replace("GROUP BY col", "GROUP BY k, col"),
    "df": "SELECT col, subject, avg(y) FILTER (period = 'debate') - avg(y) FILTER (period = 'pre') AS d FROM long GROUP BY ALL",
    "dr": "SELECT col, d, rank() OVER (PARTITION BY col, d = 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY col, d = 0, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY col, d = 0, abs(d)) AS t FROM df WHERE d IS NOT NULL",
    "wx": "SELECT col, count(*) FILTER (d <> 0) AS wn, coalesce(sum(r) FILTER (d > 0), 0.0) AS wp, count(*) FILTER (d > 0) AS pos, count(*) FILTER (d < 0) AS neg, median(d) AS med, avg(d) AS mean, coalesce(max(t) FILTER (d <> 0) > 1, false) AS ties, coalesce(sum(t * t - 1) FILTER (d <> 0), 0.0) AS tt FROM dr GROUP BY col",
    "ways": WAYS_SQL,
    "cv": "SELECT col, avg((y IS NOT NULL)::INT) FILTER (period = 'pre') AS cp, avg((y IS NOT NULL)::INT) FILTER (period = 'debate') AS cd FROM long GROUP BY col",
    "bd": "SELECT col, max(beta) FILTER (k = 1) AS b1, max(beta) FILTER (k = 2) AS b2 FROM mx_full GROUP BY col",
}
_TASK_OUT = "cv.col AS \"column\", f.n AS n, subjects, (ratio < (SELECT max(ratio) FROM mx_r))::INT AS converged, sign_flip, wn AS wilcoxon_n, pos AS wilcoxon_positive, neg AS wilcoxon_negative, " + _r6({
    "beta": "beta", "se": "se", "p": norm_p_sql("beta / se"), "icc": "ratio / (1 + ratio)", "loso_min": "loso_min", "loso_max": "loso_max", "loso_max_delta": "loso_max_delta", "wilcoxon_w_plus": "wp",
    "wilcoxon_p": wilcoxon_p_sql("wn", "wp", "ties", "tt"), "wilcoxon_median_diff": "med", "wilcoxon_mean_diff": "mean", "coverage_pre": "cp", "coverage_debate": "cd", "beta_drop1": "b1", "beta_drop2": "b2",
})


def _variant_sql() -> dict[str, str]:
    """All conduct variants from their legs: U scores and monotone ones."""
    legs = {k: c for k, c in conduct.U_LEGS.items() if c in ("attention_mean", "acc_std", "attention_std")}
    from relisense.plans.tables import u_expr, u_sql

    out = {k: v for leg, c in legs.items() for k, v in u_sql(f"uv_{leg}", "feat", c).items()} | _mono_cte("ma", "feat", "attention_mean") | _mono_cte("mm", "feat", "acc_std")
    have = {leg: u_expr(f"uv_{leg}", c) for leg, c in legs.items()} | {"attention_mono": _mono("ma", "attention_mean", 1), "acc_hi": _mono("mm", "acc_std", 1), "acc_lo": _mono("mm", "acc_std", -1)}
    variants = {v: [x for x in parts if x in have] for v, parts in conduct.VARIANTS.items()}
    return out | {"lg": f"SELECT subject, win, {', '.join(f'{e} AS {leg}' for leg, e in have.items())} FROM feat", "vr": f"SELECT subject, win, {', '.join(f'{mean_sql(x)} AS S_cond_{v}' for v, x in variants.items() if x)} FROM lg"}


_VARIANTS = [v for v, parts in conduct.VARIANTS.items() if any(x in ("attention", "acc_movement", "attention_std", "attention_mono", "acc_hi", "acc_lo") for x in parts)]
_COMPONENTS = _RATED | _variant_sql() | {
    "cmp": "SELECT r.subject, r.win, coalesce(r.S_estab, me) AS S_estab_imputed, coalesce(r.S_coher_1, m1) AS S_coher_1_imputed, coalesce(r.S_coher_5, m5) AS S_coher_5_imputed, " + ", ".join(f"vr.S_cond_{v}" for v in _VARIANTS) + ", " + ", ".join(f"r.{t}" for t in DISAGREEMENT) + " FROM (SELECT * EXCLUDE (me, m1, m5, mc) FROM rtd) r JOIN vr ON vr.subject = r.subject AND vr.win = r.win, me",
    "prs": _pairs_sql(_R9({f"{x}|{t}": (x, t) for x in ["S_estab_imputed", "S_coher_1_imputed", "S_coher_5_imputed", *[f"S_cond_{v}" for v in _VARIANTS]] for t in DISAGREEMENT}), "cmp"),
    **_spearman_sql("test"), **_POOL,
}
_PAIRED = _TEN | _DIS | {
    "prs": " UNION ALL ".join(f"SELECT w.subject, '{p}|{t}' AS test, coalesce(c_1, (SELECT median(c_1) FROM w_{p})) AS x, {t} AS y FROM w_{p} w JOIN dis ON dis.subject = w.subject AND dis.win = w.win WHERE {t} IS NOT NULL" for p in PAIRS for t in DISAGREEMENT), **_LEVERAGE,
}
_HIGH = _SCORED | _DIS | {"rtf": f"SELECT s.subject, s.win, s.S_coher_1, {', '.join(f'f.{c}_std' for c in CORE)}, s.acc_std, {', '.join(f'dis.{t}' for t in DISAGREEMENT)} FROM scored s JOIN feat f ON f.subject = s.subject AND f.win = s.win LEFT JOIN dis ON dis.subject = s.subject AND dis.win = s.win"} | _MOD

QUERIES = {
    "composite_family": (composite_family, with_sql(["feat", "rat"], _TESTED, _RATED | {"prs": _pairs_sql(_R9({f"{s}|{t}": (s, t) for s in ("score_3", "score_2", "score_3_prev5") for t in DISAGREEMENT}), "rtd"), **_spearman_sql("test"), **_POOL})),
    "component_family": (component_family, with_sql(["feat", "rat"], _TESTED, _COMPONENTS)),
    "pair_family": (pair_family, with_sql(["feat", "rat"], "SELECT test, n, most_influential, (p_fdr <= 0.05)::INT AS reject_fdr, " + _r6(["rho_full", "rho_between", "rho_within", "p_within", "p_bonferroni", "p_fdr", "loso_min", "loso_max", "loso_max_delta"]) + " FROM adj", _PAIRED)),
    "moderator_split": (moderator_split, with_sql(["feat", "rat"], "SELECT c.side, c.test, n, n_held, " + _r6({"r": "r", "p": corr_p_sql("r", "n"), "r_held": "r_held", "p_held": corr_p_sql("r_held", "n_held", 1)}) + " FROM cor c LEFT JOIN hr ON hr.side = c.side AND hr.test = c.test WHERE n >= 10", _HIGH)),
    "task_validity": (task_validity, with_sql(["feat"], f"SELECT {_TASK_OUT} FROM cv LEFT JOIN (SELECT * FROM mx_full WHERE k = 0) f ON f.col = cv.col LEFT JOIN lo ON lo.k = 0 AND lo.col = cv.col LEFT JOIN wx ON wx.col = cv.col LEFT JOIN bd ON bd.col = cv.col LEFT JOIN ways ON ways.n = wx.wn", _TASK)),
}
