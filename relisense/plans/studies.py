"""The three studies end to end, on tables that the caller reads (see ``relisense.sources``).

Each returns named result tables, all lazy but for fitted parameters and the kept feature
table, so that a caller writes only what it wants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relisense.functions.columns import unique_columns
from relisense.functions.keep import keep
from relisense.operators import classify, conduct, labels, models, quality, ranks, variance, waveform, windows
from relisense.operators.scores import ClassicZ, MinMax, UScore, composite_imputed

STABILITY_CHANNELS = ["bvp", "eda", "hr", "temp", "ibi"]
RATER_TARGETS = ["valence_var", "valence_range", "arousal_var", "valence_self_partner_diff", "valence_self_external_diff"]


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns of earlier result files under their present names (old to new); names that are not there are skipped."""
    return unique_columns(df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns}))


def window_features(signal: DataFrame, core: list[str], aux: list[str], raters: DataFrame | None = None, width: float = windows.WINDOW_S) -> DataFrame:
    """Wide window table from (subject, channel, t, value, pos): times in seconds from the subject's start."""
    rel = windows.relative_time(windows.epoch_seconds(signal, ["subject", "channel"]))
    return windows.window_table(windows.window_signal(rel, "t_rel", width), core, aux, raters)


def score_windows(features: DataFrame, stability: list[str] = STABILITY_CHANNELS, pair: tuple[str, str] = ("hr_mean", "eda_mean"), cond: str = "S_cond_att_acc") -> DataFrame:
    """Adds stability, conduct variants, coherence over 1 and 5 windows and the composites.

    Population parameters are fitted on all rows; exclude subjects afterwards, not before.
    """
    f = conduct.add_conduct_variants(conduct.add_stability(keep(features), stability))
    f = keep(conduct.add_coherence(f, {"S_coher": pair}, [1, 5]))
    f = composite_imputed(f, "S_estab", "S_coher_1", cond, name="score")
    f = composite_imputed(f, "S_estab", "S_coher_1", None, name="score_two_leg")
    return keep(composite_imputed(f, "S_estab", "S_coher_5", cond, name="score_prev5"))


def window_study(scored: DataFrame, targets: list[str], excluded: DataFrame | None = None, times: DataFrame | None = None, width: float = windows.WINDOW_S) -> dict[str, DataFrame]:
    """Statistics of a scored window table; ``excluded`` (subject) and ``times`` are optional."""
    f = scored if excluded is None else keep(quality.filter_features(scored, excluded))
    legs = [c for c in f.columns if c.startswith(("S_cond_", "S_coher_")) or c == "S_estab"]
    pairs = ranks.long_pairs(f, {f"{m}|{t}": (m, t) for m in [*legs, "score"] for t in targets})
    out = {
        "coverage": quality.coverage(f, [*legs, "score"]), "describe": quality.describe(f, [*legs, "score"]), "windows": f.groupBy("subject").count(),
        "components": ranks.adjust(ranks.with_p(ranks.correlations(pairs, ["test"]))), "leverage": ranks.leverage(f, "score", targets),
        "independence": ranks.with_p(ranks.correlations(ranks.long_pairs(f, {"estab|coher": ("S_estab", "S_coher_1")}), ["test"], "pearson")), "out_of_range": quality.out_of_range(f, [*legs, "score"]),
    }
    if times is not None:
        out["periods"] = windows.assign_period(f, times, width)
    return out


def confound_control(features: DataFrame, x: str, target: str, controls: list[str]) -> DataFrame:
    """(controls, n, r): correlation of subjects' means, alone and with each control and all held."""
    names = [x, target, *controls]
    means = features.groupBy("subject").agg(*[F.avg(c).alias(c) for c in names]).withColumn("one", F.lit(1))
    parts = [ranks.correlations(ranks.long_pairs(means, {"none": (x, target)}), ["test"], least=3).withColumnRenamed("test", "controls")]
    for held in [*[[c] for c in controls], *([controls] if len(controls) > 1 else [])]:
        name = held[0] if len(held) == 1 else "all"
        parts.append(ranks.partial_spearman(means, ["one"], x, target, held, least=3).select(F.lit(name).alias("controls"), "n", "r"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def partial_within(features: DataFrame, x: str, target: str, controls: list[str], least: int = 10, digits: int | None = None) -> DataFrame:
    """(n, r): partial Spearman of subject-centred values; needs three subjects."""
    names = [x, target, *controls]
    rows = windows.centred(features.dropna(subset=names), names)
    if rows.select("subject").distinct().limit(3).count() < 3:
        return rows.select(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("r")).limit(0)
    rows = rows.select(F.lit(1).alias("one"), *[F.col(f"{c}_c").alias(c) for c in names])
    return ranks.partial_spearman(rows, ["one"], x, target, controls, least, digits).select("n", "r")


def trial_study(hr: DataFrame, et: DataFrame, label_lists: DataFrame, metrics: list[str]) -> dict[str, DataFrame]:
    """From two trial tables (item, subject, ...) and (item, label): item scores and their tests.

    Items are reduced to those in both tables before anything is fitted.
    """
    a, b = quality.common_keys(hr, et)
    t = keep(a.join(b, ["item", "subject"]))
    lab = labels.label_entropy(label_lists, "item")
    items = t.groupBy("item").agg(*[F.avg(m).alias(m) for m in metrics]).join(lab, "item")
    tests = ranks.with_p(ranks.correlations(ranks.long_pairs(items, {m: (m, "entropy") for m in metrics}), ["test"]))
    classes = items.select("hard", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("_m")).select("hard", "_m.*")
    kw = ranks.with_chi2_p(ranks.kruskal(classes, ["metric"], "hard", "v", least=10).withColumn("df", F.col("k") - 1), "h", "df")
    pool = tests.select(F.concat(F.lit("spearman|"), "test").alias("test"), "n", F.col("r").alias("statistic"), "p").unionByName(kw.select(F.concat(F.lit("kruskal|"), "metric").alias("test"), "n", F.col("h").alias("statistic"), "p"))
    parts = variance.variance_decomposition(t, metrics)
    spread = variance.dispersion(t, metrics).join(lab.select("item", "entropy"), "item")
    return {
        "overlap": labels.source_overlap(hr, et, label_lists), "items": items, "tests": ranks.adjust(pool), "variance": variance.power_bound(parts), "viewers": labels.coverage_structure(t),
        "pairs": variance.pooled_pairs(variance.viewer_pairs(t, metrics)), "dispersion": ranks.with_p(ranks.correlations(ranks.long_pairs(spread, {m: (m, "entropy") for m in metrics}), ["test"], least=30)),
    }


def record_study(records: DataFrame, ground_truth: DataFrame, replicas: int = 2000, splits: int = 200) -> dict[str, DataFrame]:
    """From (record, leads) and (record, label): features once, then validation, comparison,
    calibration, overlap and ablation."""
    f = keep(waveform.record_features(records).join(ground_truth, "record").where("label is not null"))
    m = UScore.fit(f, ["sigma"])["sigma"]
    f = f.withColumn("u", m.score("sigma")).withColumn("decay", m.score("sigma", shape="mono")).withColumn("classic", ClassicZ.fit(f, "sigma").score("sigma")).withColumn("minmax", MinMax.fit(f, "sigma").score("sigma"))
    f = ranks.average_rank(f.withColumn("one", F.lit(1)), ["one"], "sigma", "_r").withColumn("percentile", F.col("_r") / f.count()).drop("one", "_r")
    kurtosis = classify.with_sentinel(f.where("ksqi is not null or degenerate"), "ksqi", name="ksqi_score")
    full = keep(classify.with_sentinel(kurtosis.where("corr is not null or degenerate"), "corr", name="corr_score"))
    methods = ["u", "ksqi_score", "corr_score"]
    rows = classify.long_scores(full, methods)
    thresholds = classify.long_scores(full, methods).groupBy("method").agg(F.percentile("score", F.lit(0.5)).alias("t"))
    thresholds = thresholds.withColumn("t", F.when(F.col("method") == "u", 0.5).otherwise(F.col("t")))
    pairs = [("u", "ksqi_score"), ("u", "corr_score")]
    ablation = ["u", "decay", "classic", "percentile", "minmax"]
    label = lambda df, a, b: df.withColumn("a", F.lit(a)).withColumn("b", F.lit(b))
    union = lambda parts: parts[0].unionByName(parts[1])
    return {
        "features": full, "validation": classify.classification(rows.join(thresholds, "method"), ["method"], F.col("t")), "precision": classify.average_precision(rows, ["method"]), "roc": classify.roc_points(rows, ["method"]),
        "delong": union([label(classify.delong(full, a, b), a, b) for a, b in pairs]), "bootstrap": union([label(classify.bootstrap_auc(full, a, b, replicas=replicas), a, b) for a, b in pairs]),
        "calibration": classify.split_summary(classify.split_half(full, "sigma", splits=splits)), "overlap": classify.overlap_analysis(full, "sigma", "u"), "errors": classify.error_breakdown(full, "sigma", "u"),
        "ablation": classify.auc(classify.long_scores(full, ablation), ["method"]), "points": classify.operating_points(full, methods),
    }


def task_study(scored: DataFrame, times: DataFrame, columns: list[str], width: float = windows.WINDOW_S):
    """The period contrast of each column (a row per column)."""
    return models.task_validity(keep(windows.assign_period(scored, times, width)), columns)
