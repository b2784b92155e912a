"""The legs of the window-level and trial-level composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relisense.functions.columns import row_mean
from relisense.functions.keep import keep
from relisense.operators.scores import Monotone, UScore, coherence, composite, imputed, z_baseline
from relisense.operators.windows import baseline_coherence

#: Behaviour legs by U score, by monotone score (column, direction), and the variants that average them.
U_LEGS = {"attention": "attention_mean", "acc_movement": "acc_std", "meditation": "meditation_mean", "attention_std": "attention_std", "meditation_std": "meditation_std", "self_valence": "self_valence_rstd", "self_arousal": "self_arousal_rstd"}
MONO_LEGS = {"attention_mono": ("attention_mean", 1), "meditation_mono": ("meditation_mean", 1), "acc_hi": ("acc_std", 1), "acc_lo": ("acc_std", -1)}
VARIANTS = {
    "att": ["attention"], "att_acc": ["attention", "acc_movement"], "att_med": ["attention", "meditation"], "att_std": ["attention_std"], "att_med_std": ["attention_std", "meditation_std"], "self": ["self_valence", "self_arousal"],
    "combined": ["attention", "acc_movement", "meditation", "self_valence", "self_arousal"], "att_mono": ["attention_mono"], "att_med_mono": ["attention_mono", "meditation_mono"], "att_mono_acc_hi": ["attention_mono", "acc_hi"], "att_mono_acc_lo": ["attention_mono", "acc_lo"],
}


def add_stability(features: DataFrame, channels: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Adds ``{ch}_S_estab`` for channels that have a ``{ch}_std`` column, and their row mean ``S_estab``."""
    have = [c for c in channels if f"{c}_std" in features.columns]
    models = UScore.fit(features if fit_on is None else fit_on, {c: f"{c}_std" for c in have})
    out = features.withColumns({f"{c}_S_estab": models[c].score(f"{c}_std") for c in have})
    return out.withColumn("S_estab", row_mean([f"{c}_S_estab" for c in have]))


def add_coherence(features: DataFrame, pairs: dict[str, tuple[str, str]], n_prev: list[int]) -> DataFrame:
    return baseline_coherence(features, pairs, n_prev)


def add_conduct_variants(features: DataFrame, u_legs: dict[str, str] = U_LEGS, mono_legs: dict[str, tuple[str, int]] = MONO_LEGS, variants: dict[str, list[str]] = VARIANTS) -> DataFrame:
    """Adds ``R_{leg}`` for every leg whose column exists, and ``S_cond_{variant}``: row means
    of the legs that are there, NULL without any."""
    u = {k: c for k, c in u_legs.items() if c in features.columns}
    m = {k: v for k, v in mono_legs.items() if v[0] in features.columns}
    um, mm = UScore.fit(features, u) if u else {}, Monotone.fit(features, m) if m else {}
    out = features.withColumns({f"R_{k}": um[k].score(c) for k, c in u.items()} | {f"R_{k}": mm[k].score(c) for k, (c, _) in m.items()})
    return out.withColumns({f"S_cond_{v}": row_mean([f"R_{x}" for x in legs if x in u or x in m]) for v, legs in variants.items()})


def trial_scores(trials: DataFrame, stability: dict[str, str], reaction: str, blink: str, reaction_form: str = "u", null_policy: str = "one") -> DataFrame:
    """Adds ``S_{name}`` per stability column and ``S_cond``: mean of the reaction and blink legs.

    reaction_form "u", or "mono": fast reactions score higher. null_policy "one": missing
    deviations count as stable, "null": they stay missing.
    """
    models = UScore.fit(trials, stability | {"_rt": reaction, "_bl": blink})
    rt = models["_rt"].score(reaction, null_policy) if reaction_form == "u" else Monotone.fit(trials, {"r": (reaction, -1)})["r"].score(reaction)
    out = trials.withColumns({f"S_{k}": models[k].score(c, null_policy) for k, c in stability.items()})
    return out.withColumn("S_cond", (rt + models["_bl"].score(blink, null_policy)) / 2)


def trial_coherence(trials: DataFrame, a: tuple[str, str], b: tuple[str, str], subject: str = "subject", name: str = "S_coher") -> DataFrame:
    """Adds the coherence of two (value, baseline) column pairs, by the subject's own deviations.

    Deviations are kept, so that their size is known before the join: while they are few, trials
    are not dealt by subject.
    """
    stds = keep(trials.groupBy(subject).agg(F.nullif(F.stddev_samp(a[0]), F.lit(0.0)).alias("_sa"), F.nullif(F.stddev_samp(b[0]), F.lit(0.0)).alias("_sb")))
    return trials.join(stds, subject, "left").withColumn(name, coherence(z_baseline(*a, "_sa"), z_baseline(*b, "_sb"))).drop("_sa", "_sb")


def trial_composite(trials: DataFrame, estab: str = "S_estab", coher: str = "S_coher", cond: str = "S_cond", name: str = "score") -> DataFrame:
    return trials.withColumn(name, composite([estab, coher, cond], [1 / 3, 1 / 3, 1 / 3]))


def item_composite(items: DataFrame, stability: list[str], coher: str, cond: str, name: str = "score") -> DataFrame:
    """Stability as the plain mean of its columns, each leg median-imputed, equal weights; where a
    leg is still missing, the mean of what is there."""
    total = None
    for c in stability:
        total = F.col(c) if total is None else total + F.col(c)
    out = imputed(items.withColumn("S_estab", total / len(stability)), ["S_estab", coher, cond])
    legs = [f"{c}_imputed" for c in ("S_estab", coher, cond)]
    return out.withColumn(name, F.coalesce(composite(legs, [1 / 3, 1 / 3, 1 / 3]), row_mean(legs)))


def two_leg(df: DataFrame, estab: str, coher: str, name: str) -> DataFrame:
    return df.withColumn(name, composite([estab, coher], [0.5, 0.5]))
