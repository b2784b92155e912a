"""Language identification by multilingual mixture inference.

Letter trigrams (hashed) give each language a multinomial. A document is a mixture of
languages; expectation-maximisation estimates the proportions from its trigram counts.
Of the nested sets of languages by proportion (up to all of them), the one with the best
penalised likelihood is selected, and the language with the largest share in it is the
prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relisense.llm.shared import small_batches

BUCKETS = 1 << 15
#: Labelled documents per language that the model is fitted on, about; those with the
#: smallest hashed ids, so a larger corpus doesn't make a larger model.
TRAIN_PER_LANGUAGE = 3000
SMOOTHING = 0.1
EM_STEPS = 12
#: Cost of one more language: this many times the logarithm of the number of trigrams.
PENALTY = 3.0
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def trigram_buckets(text: str | None) -> np.ndarray:
    """Bucket of each letter trigram; runs of anything but letters count as one space.

    Trigrams around a space in the middle are left out. Empty if there is no letter.
    """
    if not text:
        return np.zeros(0, dtype=np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    letter = _is_letter()[c]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    c[~letter] = 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of spaces the first stays
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint64)
    mid = c[1:-1] != 32
    with np.errstate(over="ignore"):
        x = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)[mid]


@dataclass
class LanguageModel:
    languages: list[str]
    #: Probability of each bucket (rows) under each language (columns).
    prob: np.ndarray

    def mixture(self, p: np.ndarray, n: np.ndarray, which: list[int]) -> tuple[np.ndarray, float, float]:
        """Proportions of these languages, the log-likelihood for bucket rows p counted n times, and
        a bound that no mixture of them can exceed (the likelihood is concave in the proportions)."""
        q = p[:, which]
        share = np.full(len(which), 1 / len(which))
        total = n.sum()
        if len(which) > 1:
            for _ in range(EM_STEPS):
                w = q * share
                share = (n / w.sum(axis=1)) @ w / total
        mix = q @ share
        fit = float(n @ np.log(mix))
        return share, fit, fit + float(((n / mix) @ q).max() - total)

    def predict(self, text: str | None) -> tuple[str, float, str]:
        """(language, its share, selected languages with shares); ties go to the earlier name."""
        b = trigram_buckets(text)
        if not len(b) or not self.languages:
            return UNDETERMINED, 0.0, ""
        at, n = np.unique(b, return_counts=True) if len(b) < 4000 else _counted(b)
        p, n = self.prob[at], n.astype(float)
        share, _, bound = self.mixture(p, n, list(range(len(self.languages))))
        order = np.argsort(-share, kind="stable").tolist()
        best = None
        for k in range(1, len(order) + 1):
            cost = PENALTY * (k - 1) * np.log(len(b) + 1)
            if best is not None and bound - cost <= best[0]:
                break  # no set of k or more languages can be better
            own, fit, _ = self.mixture(p, n, order[:k])
            fit -= cost
            if best is None or fit > best[0]:
                best = (fit, order[:k], own)
        _, which, own = best
        top = int(np.argmax(own))
        return self.languages[which[top]], float(min(1.0, own[top])), ",".join(f"{self.languages[i]}:{s:.3f}" for i, s in zip(which, own, strict=True))


def _counted(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(b, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits the model on about TRAIN_PER_LANGUAGE documents of each language.

    Counts are summed on Spark; what reaches the driver is a number per language and bucket.
    Rows without text or language are left out, repeated ones count as often as they stand
    (all or none of an id's are in the sample), long texts count whole; other columns are not
    read. An empty table, or one without a language, gives a model of no languages.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not size:
        return LanguageModel([], np.zeros((BUCKETS, 0)))
    share = F.create_map(*[F.lit(x) for k, n in size.items() for x in (k, min(1.0, TRAIN_PER_LANGUAGE / n))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                n = np.bincount(trigram_buckets(text), minlength=BUCKETS)
                total[lang] = total[lang] + n if lang in total else n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    counted = sample.mapInPandas(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(size)
    counts = np.full((BUCKETS, len(names)), SMOOTHING)
    for r in counted.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).collect():  # a row per language
        counts[r["b"], names.index(r["lang"])] += r["n"]
    return LanguageModel(names, counts / counts.sum(axis=0))


def identify(text: Column | str, model: LanguageModel) -> Column:
    """struct<lang, score, langs> of a text column. Null texts and texts without a letter: und, 0.

    Long texts are read whole; equal texts get equal answers, of equally likely languages the
    first of the model's; a model of no languages answers und. The column comes beside any
    others, whatever their names; an empty table gives no rows.
    """
    languages, prob = model.languages, model.prob

    @F.pandas_udf("lang string, score double, langs string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = LanguageModel(languages, prob)
        for batch in batches:
            yield pd.DataFrame([own.predict(t) for t in batch], columns=["lang", "score", "langs"])

    return run.asNondeterministic()(text)  # or a filter on the result would have it run twice


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; a null id has none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit_on_documents(docs: DataFrame) -> LanguageModel:
    """The model of everything but the held-out fourth."""
    return fit(docs.where(remainder() != 2))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), identify("text", fit_on_documents(docs)).alias("_l"))
    return found.select("doc_id", "held_out", F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"), F.col("_l.langs").alias("langs"))
