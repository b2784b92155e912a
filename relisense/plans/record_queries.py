"""Record-level study: waveform features and classifier audits, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from relisense.functions.columns import rounded
from relisense.functions.keep import keep
from relisense.functions.ordered import with_position
from relisense.operators import beats, classify, mixed, models, ranks, waveform
from relisense.operators.scores import ClassicZ, MinMax, UScore
from relisense.plans.tables import corr_sql, graded, mixed_sql, norm_p_sql, records, signal, u_expr, u_sql, with_sql
from relisense.plans.window_queries import _r, _r6, features


MIXED = ["hr_mean", "eda_mean", "bvp_mean", "attention_mean"]


def _samples(spark, d):
    return waveform.long_leads(records(spark, d))


def scored(spark, d):
    """Graded records with their U score and four ablations."""
    g = graded(spark, d)
    u = UScore.fit(g, ["sigma"])["sigma"]
    g = g.withColumn("u", u.score("sigma")).withColumn("decay", u.score("sigma", shape="mono")).withColumn("classic", ClassicZ.fit(g, "sigma").score("sigma")).withColumn("minmax", MinMax.fit(g, "sigma").score("sigma"))
    r = ranks.average_rank(g.withColumn("one", F.lit(1)), ["one"], "sigma", "_r")
    n = g.count()
    return keep(r.withColumn("percentile", F.col("_r") / n).drop("one", "_r").withColumn("fail", F.col("toxic") == 1))


def std_signal(spark, d):
    return _r(waveform.std_signal(_samples(spark, d)), ["record"], ["sigma"])


def std_window(spark, d):
    return _r(waveform.std_window(_samples(spark, d), 3), ["record"], ["sigma"])


def kurtosis_sqi(spark, d):
    return _r(waveform.kurtosis_sqi(_samples(spark, d)), ["record"], ["ksqi"])


def lead_correlation(spark, d):
    return _r(waveform.lead_correlation(_samples(spark, d)), ["record"], ["corr"])


def spectral_snr(spark, d):
    r = records(spark, d).withColumn("lead0", F.col("leads")[0]).withColumn("fs", F.lit(8.0))
    return waveform.spectral_snr(r, "lead0", "fs", 0.5, 2.5).select("record", rounded("snr").alias("snr"))


def beat_intervals(spark, d):
    r = records(spark, d).withColumn("lead0", F.flatten("leads")).withColumn("fs", F.lit(8.0))
    return waveform.beat_interval_std(r, "lead0", "fs").select("record", rounded("rr_std").alias("rr_std"), "fail")


def sentinel_scores(spark, d):
    s = _samples(spark, d).withColumn("v", F.when((F.col("record") % 9 == 0) & (F.col("lead") == 2), 1.0).otherwise(F.col("v")))
    k = classify.with_sentinel(waveform.kurtosis_sqi(s), "ksqi")
    return k.select("record", F.col("degenerate").cast("int").alias("degenerate"), rounded("score").alias("score"))


def confusion(spark, d):
    rows = classify.long_scores(scored(spark, d), ["u", "minmax"])
    return _r(classify.confusion(rows, ["method"], 0.5), ["method", "tp", "fp", "tn", "fn"], ["accuracy", "sensitivity", "specificity", "gmean"])


def ablation_auc(spark, d):
    rows = classify.long_scores(scored(spark, d), ["u", "decay", "classic", "minmax", "percentile"])
    return _r(classify.auc(rows, ["method"]), ["method", "n"], ["auc"])


def roc_points(spark, d):
    rows = classify.long_scores(scored(spark, d).withColumn("sig", F.col("sigma")), ["sig"])
    return _r(classify.roc_points(rows, ["method"]), ["method", "threshold", "tp", "fp"], ["tpr", "fpr", "precision"])


def average_precision(spark, d):
    rows = classify.long_scores(scored(spark, d), ["sigma", "other"])
    return _r(classify.average_precision(rows, ["method"]), ["method"], ["ap"])


def all_versus_valid(spark, d):
    rows = scored(spark, d).withColumn("score", F.col("sigma"))
    return _r(classify.all_versus_valid(rows, 1000.0), [], ["auc_all", "auc_valid", "gmean_all", "gmean_valid", "delta_auc"])


def threshold_curve(spark, d):
    rows = classify.long_scores(scored(spark, d), ["sigma"])
    return classify.threshold_curve(rows, ["method"]).select("method", F.round("threshold", 3).alias("threshold"), rounded("tpr").alias("tpr"), rounded("fpr").alias("fpr"))


def operating_points(spark, d):
    return _r(classify.operating_points(scored(spark, d), ["sigma", "other"]), ["method"], ["threshold", "tpr", "fpr"])


def delong(spark, d):
    return _r(classify.delong(scored(spark, d), "sigma", "other"), [], ["auc_a", "auc_b", "diff", "var", "z", "p"])


def bootstrap(spark, d):
    return _r(classify.bootstrap_auc(scored(spark, d), "sigma", "other"), ["used"], ["diff", "ci_low", "ci_high", "p"])


def split_half(spark, d):
    return _r(classify.split_summary(classify.split_half(graded(spark, d), "sigma")), ["splits"], ["mean", "median", "std", "ci_low", "ci_high"])


def overlap(spark, d):
    return _r(classify.overlap_analysis(scored(spark, d), "sigma", "u"), ["part", "n"], ["in_zone"])


def error_breakdown(spark, d):
    return _r(classify.error_breakdown(scored(spark, d), "sigma", "u"), ["n_fn", "n_fp"], ["fn_outside", "fp_distance"])


def agreement(spark, d):
    f = features(spark, d).select("subject", F.col("hr_mean").alias("x"), F.col("eda_mean").alias("y"))
    return _r(classify.agreement(f, ["subject"]), ["subject", "n"], ["ccc", "rmse", "mae"])


def regression(spark, d):
    """Standardised least squares of one channel on two others."""
    t = models.ols(features(spark, d), "hr_mean", ["eda_mean", "bvp_mean"])
    return _r(spark.createDataFrame(t), ["term", "n"], ["beta"])


def mixed_model(spark, d):
    """Contrast of purchase days within subject, by random intercept, for every other channel; and without each subject."""
    f = features(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("y")) for c in MIXED]))
    rows = f.select("subject", F.col("acc_mean").isNotNull().cast("int").alias("x"), each.alias("_c")).select("subject", "x", "_c.*")
    return _mixed_result(mixed.mixed_models(rows, ["column"]))


def _mixed_result(t, *more):
    return _r(t.withColumns({c: F.col(c).cast("int") for c in ("converged", "sign_flip")}), ["column", "n", "subjects", "converged", "sign_flip"], ["beta", "se", "z", "p", "icc", "loso_min", "loso_max", "loso_max_delta", *more])


def long_beats(spark, d):
    """Beats of each subject's whole signal, taken as a record of 100 samples a second."""
    s = signal(spark, d).where("channel = 'hr'").select(F.col("subject").alias("record"), "pos", F.col("value").alias("v"))
    samples = with_position(s, ["record"], "pos", "i").select("record", "i", "v", F.lit(100.0).alias("fs"))
    return _r(beats.long_beat_intervals(samples), ["record", "beats", "fail"], ["rr_std"])


def signed_rank(spark, d):
    f = features(spark, d).select("subject", F.round(F.col("hr_mean") - F.col("eda_mean"), 9).alias("d")).dropna()
    return models.signed_rank(f, ["subject"], "d").select("subject", "n", "w_plus", "positive", "negative", rounded("median_diff").alias("median_diff"))


def paired_t(spark, d):
    f = features(spark, d).select("subject", (F.col("hr_mean") - F.col("eda_mean")).alias("d"))
    return _r(models.paired_t(f, ["subject"], "d"), ["subject", "n"], ["t"])


def histogram(spark, d):
    """Plot-ready bin counts."""
    from relisense.operators.plots import histogram as bins

    return bins(signal(spark, d), "value", 20).select("bin", "n", rounded("low", 4).alias("low"))


def boxes(spark, d):
    from relisense.operators.plots import box_stats

    return _r(box_stats(scored(spark, d), "label", "sigma"), ["label", "n"], ["low", "q1", "median", "q3", "high"])


_SC = u_sql("us", "grd", "sigma") | {
    "cz": "SELECT avg(ln(sigma + 1e-9)) AS a, stddev_pop(ln(sigma + 1e-9)) AS s FROM grd, us_e WHERE sigma >= e",
    "scd": f"SELECT *, {u_expr('us', 'sigma')} AS u, CASE WHEN sigma < (SELECT e FROM us_e) THEN 0.0 ELSE 1 / (1 + abs((ln(sigma + 1e-9) - (SELECT m FROM us_m)) / (SELECT s FROM us_s))) END AS decay, CASE WHEN sigma < (SELECT e FROM us_e) THEN 0.0 ELSE exp(-0.5 * pow((ln(sigma + 1e-9) - (SELECT a FROM cz)) / (SELECT s FROM cz), 2)) END AS classic, (sigma - min(sigma) OVER ()) / (max(sigma) OVER () - min(sigma) OVER ()) AS minmax, (rank() OVER (ORDER BY sigma) + (count(*) OVER (PARTITION BY sigma) - 1) / 2.0) / count(*) OVER () AS percentile FROM grd",
}


def _lng(methods: list[str]) -> dict[str, str]:
    return {"ls": " UNION ALL ".join(f"SELECT '{m}' AS method, label, {m}::DOUBLE AS score FROM scd" for m in methods)}


_AUC = "SELECT method, count(*) AS n, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)) AS auc FROM (SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS r FROM ls) GROUP BY method"
_CONF = "SELECT method, count(*) FILTER (score >= {t} AND label = 1) AS tp, count(*) FILTER (score >= {t} AND label <> 1) AS fp, count(*) FILTER (score < {t} AND label <> 1) AS tn, count(*) FILTER (score < {t} AND label = 1) AS fn FROM {src} GROUP BY method"
_ROC = {"rp": "SELECT method, score, sum(count(*) FILTER (label = 1)) OVER w AS tp, sum(count(*) FILTER (label <> 1)) OVER w AS fp FROM ls GROUP BY method, score WINDOW w AS (PARTITION BY method ORDER BY score DESC)", "rt": "SELECT method, count(*) FILTER (label = 1) AS m, count(*) FILTER (label <> 1) AS k FROM ls GROUP BY method"}
_ZONE = {"zn": "SELECT greatest(quantile_cont(ln(sigma + 1e-9), 0.05) FILTER (label = 0), quantile_cont(ln(sigma + 1e-9), 0.05) FILTER (label = 1)) AS a, least(quantile_cont(ln(sigma + 1e-9), 0.95) FILTER (label = 0), quantile_cont(ln(sigma + 1e-9), 0.95) FILTER (label = 1)) AS b FROM scd", "zr": "SELECT label = 1 AS pos, u >= 0.5 AS hit, (ln(sigma + 1e-9) BETWEEN (SELECT a FROM zn) AND (SELECT b FROM zn))::INT AS z FROM scd"}
_DL = {
    "dr": "SELECT label, " + ", ".join(f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 - (rank() OVER (PARTITION BY label ORDER BY {s}) + (count(*) OVER (PARTITION BY label, {s}) - 1) / 2.0) AS d{k}" for k, s in (("a", "sigma"), ("b", "other"))) + ", count(*) FILTER (label = 1) OVER () AS m, count(*) FILTER (label = 0) OVER () AS n FROM scd",
    "dv": "SELECT label, CASE WHEN label = 1 THEN da / n ELSE 1 - da / m END AS va, CASE WHEN label = 1 THEN db / n ELSE 1 - db / m END AS vb FROM dr",
    "dd": "SELECT label, count(*) AS k, avg(va) AS ma, avg(vb) AS mb, var_samp(va - vb) AS s FROM dv GROUP BY label",
    "de": "SELECT max(ma) FILTER (label = 1) AS auc_a, max(mb) FILTER (label = 1) AS auc_b, sum(s / k) AS var FROM dd",
}
_G2 = "CASE WHEN count(*) FILTER (s < 1e-6) > 0 THEN NULL ELSE avg(k) END"

_LOO = {"lo": "SELECT col, min(l.beta) AS loso_min, max(l.beta) AS loso_max, max(abs(l.beta - f.beta)) AS loso_max_delta, max((l.beta * f.beta < 0)::INT) AS sign_flip FROM mx_loo l JOIN mx_full f USING (col) GROUP BY col"}
_MIXED_OUT = "col AS \"column\", n, subjects, (ratio < (SELECT max(ratio) FROM mx_r))::INT AS converged, sign_flip, " + _r6({"beta": "beta", "se": "se", "z": "beta / se", "p": norm_p_sql("beta / se"), "icc": "ratio / (1 + ratio)", "loso_min": "loso_min", "loso_max": "loso_max", "loso_max_delta": "loso_max_delta"})

_BEATS = {
    "smp": "SELECT subject AS record, row_number() OVER (PARTITION BY subject ORDER BY pos) - 1 AS i, value - avg(value) OVER (PARTITION BY subject) AS v, lag(value) OVER w AS a, lead(value) OVER w AS b, value AS x FROM sig WHERE channel = 'hr' WINDOW w AS (PARTITION BY subject ORDER BY pos)",
    "slo": "SELECT record, i, pow(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN b - x WHEN b IS NULL THEN x - a ELSE (b - a) / 2 END, 2) AS g FROM smp",
    "enr": "SELECT record, i, sum(g) OVER (PARTITION BY record ORDER BY i ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) / 12.0::DOUBLE AS e FROM slo",
    "lvl": "SELECT *, avg(e) OVER (PARTITION BY record) + 0.5 * stddev_pop(e) OVER (PARTITION BY record) AS l, lag(e) OVER w AS p, lead(e) OVER w AS q FROM enr WINDOW w AS (PARTITION BY record ORDER BY i)",
    "pk": "SELECT record, i FROM lvl WHERE e >= p AND e > q AND e > l", "nx": "SELECT a.record, a.i, min(b.i) AS j FROM pk a LEFT JOIN pk b ON a.record = b.record AND b.i >= a.i + 25 GROUP BY ALL",
    "bts": "SELECT * FROM (WITH RECURSIVE r AS (SELECT record, min(i) AS i FROM pk GROUP BY record UNION ALL SELECT r.record, nx.j FROM r JOIN nx ON nx.record = r.record AND nx.i = r.i WHERE nx.j IS NOT NULL) SELECT * FROM r)",
    "bt": "SELECT record, count(*) AS n, sum(d) AS s, sum(d * d) AS ss FROM (SELECT record, (i - lag(i) OVER (PARTITION BY record ORDER BY i))::DOUBLE AS d FROM bts) GROUP BY record",
}

QUERIES = {
    "std_signal": (std_signal, with_sql(["smp"], "SELECT record, round(avg(s), 6) + 0.0 AS sigma FROM (SELECT record, lead, stddev_pop(v) AS s FROM smp GROUP BY ALL) GROUP BY record")),
    "std_window": (std_window, with_sql(["smp"], "SELECT record, round(median(s), 6) + 0.0 AS sigma FROM (SELECT record, w, avg(s) AS s FROM (SELECT record, lead, i // 3 AS w, stddev_pop(v) AS s, count(*) AS n FROM smp GROUP BY ALL) WHERE n = 3 GROUP BY ALL) GROUP BY record")),
    "kurtosis_sqi": (kurtosis_sqi, with_sql(["smp"], f"SELECT record, round({_G2}, 6) + 0.0 AS ksqi FROM (SELECT record, lead, stddev_pop(v) AS s, kurtosis(v) AS k FROM smp GROUP BY ALL) GROUP BY record")),
    "lead_correlation": (lead_correlation, with_sql(["smp"], f"SELECT record, round(avg(r), 6) + 0.0 AS corr FROM (SELECT a.record, a.lead AS la, b.lead AS lb, {corr_sql('a.v', 'b.v')} AS r FROM smp a JOIN smp b ON a.record = b.record AND a.i = b.i AND a.lead < b.lead GROUP BY ALL) GROUP BY record")),
    "spectral_snr": (spectral_snr, with_sql(["smp"], "SELECT record, round(10 * log10(band / (total - band)), 6) + 0.0 AS snr FROM (SELECT record, sum(p) FILTER (k BETWEEN 1 AND 2) AS band, sum(p) AS total FROM pw GROUP BY record)", {"ce": "SELECT record, i, v - avg(v) OVER (PARTITION BY record) AS v FROM smp WHERE lead = 0", "pw": "SELECT record, k, pow(sum(v * cos(2 * pi() * k * i / 8)), 2) + pow(sum(v * sin(2 * pi() * k * i / 8)), 2) AS p FROM ce CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY ALL"})),
    "beat_intervals": (beat_intervals, None),
    "sentinel_scores": (sentinel_scores, with_sql(["smp"], "SELECT record, g AS degenerate, round(CASE WHEN g = 1 THEN (SELECT min(k) - (abs(min(k)) * 0.1 + 1) FROM kk WHERE g = 0) ELSE k END, 6) + 0.0 AS score FROM kk", {"fl": "SELECT record, lead, CASE WHEN record % 9 = 0 AND lead = 2 THEN 1.0 ELSE v END AS v FROM smp", "kl": "SELECT record, lead, stddev_pop(v) AS s, CASE WHEN stddev_pop(v) >= 1e-6 THEN kurtosis(v) END AS k FROM fl GROUP BY ALL", "kk": "SELECT record, (min(s) < 1e-6)::INT AS g, avg(k) AS k FROM kl GROUP BY record"})),
    "confusion": (confusion, with_sql(["grd"], f"SELECT method, tp, fp, tn, fn, {_r6({'accuracy': '(tp + tn) / (tp + fp + tn + fn)', 'sensitivity': 'tp / (tp + fn)', 'specificity': 'tn / (tn + fp)', 'gmean': 'sqrt((tp / (tp + fn)) * (tn / (tn + fp)))'})} FROM cf", _SC | _lng(["u", "minmax"]) | {"cf": _CONF.format(t="0.5", src="ls")})),
    "ablation_auc": (ablation_auc, with_sql(["grd"], "SELECT method, n, round(auc, 6) + 0.0 AS auc FROM au", _SC | _lng(["u", "decay", "classic", "minmax", "percentile"]) | {"au": _AUC})),
    "roc_points": (roc_points, with_sql(["grd"], f"SELECT 'sig' AS method, score AS threshold, tp, fp, {_r6({'tpr': 'tp / m', 'fpr': 'fp / k', 'precision': 'tp / (tp + fp)'})} FROM rp JOIN rt ON rp.method = rt.method", _SC | _lng(["sigma"]) | _ROC)),
    "average_precision": (average_precision, with_sql(["grd"], "SELECT method, round(sum(st * pr), 6) + 0.0 AS ap FROM (SELECT rp.method, (tp - coalesce(lag(tp) OVER (PARTITION BY rp.method ORDER BY score DESC), 0)) / m AS st, tp / (tp + fp) AS pr FROM rp JOIN rt ON rp.method = rt.method) GROUP BY method", _SC | _lng(["sigma", "other"]) | _ROC)),
    "all_versus_valid": (all_versus_valid, with_sql(["grd"], f"SELECT {_r6({'auc_all': 'a.auc', 'auc_valid': 'v.auc', 'gmean_all': 'sqrt((ca.tp / (ca.tp + ca.fn)) * (ca.tn / (ca.tn + ca.fp)))', 'gmean_valid': 'sqrt((cv.tp / (cv.tp + cv.fn)) * (cv.tn / (cv.tn + cv.fp)))', 'delta_auc': 'a.auc - v.auc'})} FROM au a, au v, cf ca, cf cv WHERE a.method = 'all' AND v.method = 'valid' AND ca.method = 'all' AND cv.method = 'valid'", {"ls": "SELECT 'all' AS method, label, sigma AS score FROM grd UNION ALL SELECT 'valid', label, sigma FROM grd WHERE toxic <> 1", "au": _AUC, "cf": _CONF.format(t="1000.0", src="ls")})),
    "threshold_curve": (threshold_curve, with_sql(["grd"], "SELECT 'sigma' AS method, round(t, 3) AS threshold, round(count(*) FILTER (label = 1 AND score >= t - 1e-6) / max(m), 6) + 0.0 AS tpr, round(count(*) FILTER (label <> 1 AND score >= t - 1e-6) / max(k), 6) + 0.0 AS fpr FROM gr CROSS JOIN ls JOIN rt ON rt.method = ls.method GROUP BY t", _SC | _lng(["sigma"]) | {"rt": _ROC["rt"], "gr": "SELECT min(score) + (max(score) - min(score)) * unnest(range(0, 300)) / 299.0 AS t FROM ls"})),
    "operating_points": (operating_points, with_sql(["grd"], f"SELECT method, {_r6({'threshold': 't', 'tpr': 'count(*) FILTER (label = 1 AND score >= t) / count(*) FILTER (label = 1)', 'fpr': 'count(*) FILTER (label <> 1 AND score >= t) / count(*) FILTER (label <> 1)'})} FROM ls JOIN (SELECT method AS mm, median(score) AS t FROM ls GROUP BY method) ON method = mm GROUP BY method, t", _SC | _lng(["sigma", "other"]))),
    "delong": (delong, with_sql(["grd"], f"SELECT {_r6({'auc_a': 'auc_a', 'auc_b': 'auc_b', 'diff': 'auc_a - auc_b', 'var': 'var', 'z': '(auc_a - auc_b) / sqrt(var)', 'p': norm_p_sql('((auc_a - auc_b) / sqrt(var))')})} FROM de", _SC | _DL)),
    "bootstrap": (bootstrap, None),
    "split_half": (split_half, None),
    "overlap": (overlap, with_sql(["grd"], " UNION ALL ".join(f"SELECT '{k}' AS part, count(*) AS n, round(avg(z), 6) + 0.0 AS in_zone FROM zr WHERE {c} HAVING count(*) > 0" for k, c in (("all", "true"), ("correct", "hit = pos"), ("misclassified", "hit <> pos"), ("false_positive", "hit AND NOT pos"), ("false_negative", "pos AND NOT hit"), ("class_0", "NOT pos"), ("class_1", "pos"))), _SC | _ZONE)),
    "error_breakdown": (error_breakdown, with_sql(["grd"], "SELECT count(*) FILTER (label = 1 AND u < 0.5) AS n_fn, count(*) FILTER (label <> 1 AND u >= 0.5) AS n_fp, round(avg((x < a OR x > b)::INT) FILTER (label = 1 AND u < 0.5), 6) + 0.0 AS fn_outside, round(avg(abs(x - c)) FILTER (label <> 1 AND u >= 0.5), 6) + 0.0 AS fp_distance FROM (SELECT label, u, ln(sigma + 1e-9) AS x FROM scd), (SELECT quantile_cont(ln(sigma + 1e-9), 0.1) FILTER (label = 1) AS a, quantile_cont(ln(sigma + 1e-9), 0.9) FILTER (label = 1) AS b, median(ln(sigma + 1e-9)) AS c FROM scd)", _SC)),
    "agreement": (agreement, with_sql(["feat"], f"SELECT subject, count(*) AS n, {_r6({'ccc': '2 * covar_samp(y, x) / (var_samp(y) + var_samp(x) + pow(avg(y) - avg(x), 2))', 'rmse': 'sqrt(avg(pow(y - x, 2)))', 'mae': 'avg(abs(y - x))'})} FROM (SELECT subject, hr_mean AS x, eda_mean AS y FROM feat WHERE hr_mean IS NOT NULL AND eda_mean IS NOT NULL) GROUP BY subject")),
    "regression": (regression, with_sql(["feat"], "SELECT 'eda_mean' AS term, n, round((ya - yb * ab) / (1 - ab * ab), 6) + 0.0 AS beta FROM co UNION ALL SELECT 'bvp_mean', n, round((yb - ya * ab) / (1 - ab * ab), 6) + 0.0 FROM co", {"co": "SELECT count(*) AS n, corr(hr_mean, eda_mean) AS ya, corr(hr_mean, bvp_mean) AS yb, corr(eda_mean, bvp_mean) AS ab FROM feat WHERE hr_mean IS NOT NULL AND eda_mean IS NOT NULL AND bvp_mean IS NOT NULL"})),
    "mixed_model": (mixed_model, with_sql(["feat"], f"SELECT {_MIXED_OUT} FROM mx_full f LEFT JOIN lo USING (col)", {"src": " UNION ALL ".join(f"SELECT '{c}' AS col, subject, (acc_mean IS NOT NULL)::INT AS x, {c} AS y FROM feat" for c in MIXED)} | mixed_sql("src", "col") | _LOO)),
    "long_beats": (long_beats, with_sql(["sig"], f"SELECT sm.record, coalesce(n, 0) AS beats, coalesce(n, 0) < 2 AS fail, {_r6({'rr_std': 'CASE WHEN n >= 2 THEN sqrt(greatest(ss / (n - 1) - pow(s / (n - 1), 2), 0.0)) / 100.0 ELSE 0.0 END'})} FROM (SELECT DISTINCT record FROM smp) sm LEFT JOIN bt ON bt.record = sm.record", _BEATS)),
    "signed_rank": (signed_rank, with_sql(["feat"], "SELECT subject, count(*) FILTER (d <> 0) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d < 0) AS negative, round(median(d), 6) + 0.0 AS median_diff FROM (SELECT subject, d, rank() OVER (PARTITION BY subject, d = 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY subject, d = 0, abs(d)) - 1) / 2.0 AS r FROM df) GROUP BY subject", {"df": "SELECT subject, round(hr_mean - eda_mean, 9) AS d FROM feat WHERE hr_mean IS NOT NULL AND eda_mean IS NOT NULL"})),
    "paired_t": (paired_t, with_sql(["feat"], "SELECT subject, count(d) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) + 0.0 AS t FROM (SELECT subject, hr_mean - eda_mean AS d FROM feat) GROUP BY subject")),
    "histogram": (histogram, with_sql(["sig"], "SELECT bin, count(*) AS n, round(a + (b - a) * bin / 20.0, 4) + 0.0 AS low FROM (SELECT least(19, floor((value - a) / (b - a) * 20.0)::INT) AS bin, a, b FROM sig, (SELECT min(value) AS a, max(value) AS b FROM sig)) GROUP BY bin, a, b")),
    "boxes": (boxes, with_sql(["grd"], f"SELECT label, count(*) AS n, {_r6({'low': 'min(sigma)', 'q1': 'quantile_cont(sigma, 0.25)', 'median': 'median(sigma)', 'q3': 'quantile_cont(sigma, 0.75)', 'high': 'max(sigma)'})} FROM grd GROUP BY label")),
}
