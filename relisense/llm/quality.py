"""Quality verdict by a hashed n-gram likelihood ratio, with plain rules as a floor.

Two multinomials over hashed n-grams are estimated: one from trusted documents, one from
all documents. A document's score is the mean log ratio of its n-grams; it is kept if the
base rules pass and the score reaches a threshold: half way between the trusted documents'
low quantile and the high quantile of documents labelled bad (that low quantile itself
where none is labelled bad), both over documents that pass the base rules. The n-grams are
the words and the pairs of neighbouring words, whole and as they stand.

Everything is DataFrame expressions; each text is reduced inside its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relisense.functions.quantiles import quantiles
from relisense.llm.shared import shared_root

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Quantiles that set the threshold.
TRUSTED_LOW, BAD_HIGH = 0.002, 0.95
SPACE = " \t\n\x0b\f\r"


def _expr(sql: str) -> Column:
    return F.expr(sql)


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_text`` (null: empty), ``_words`` and their ``_hashes``."""
    out = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    bare = F.trim(F.col("_text"), F.lit(SPACE))
    out = out.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    return out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def _buckets() -> Column:
    """The document's words and pairs of words as bucket numbers."""
    pairs = f"transform(slice(_hashes, 1, greatest(size(_hashes) - 1, 0)), (x, i) -> cast(pmod(xxhash64(x, get(_hashes, i + 1)), {BUCKETS}) as int))"
    return _expr(f"concat(transform(_hashes, x -> cast(pmod(x, {BUCKETS}) as int)), {pairs})")


def with_base(words: DataFrame, hash_mask: int = -1) -> DataFrame:
    """Adds the base figures. n_repeat_words: equal windows of three words are found by
    sorting (hash, position) packed in one number per window; the words they cover are
    counted from the sorted positions. Windows of equal hash are compared word by word; a
    text in which two of them differ is sorted by its words instead, so figures are exact.
    hash_mask: bits of the hash that count (tests leave few, to have such texts)."""
    out = words.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.concat_ws("", "_words")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"))
    lines = _expr(r"filter(split(_text, '\n', -1), x -> x rlike r'[^\x20\x09-\x0D]')")
    out = out.withColumn("_lines", F.when(F.col("_text").contains("\n"), lines).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = out.withColumn("_bits", _expr("length(bin(size(_words)))")).withColumn("_low", _expr("shiftleft(1L, _bits) - 1"))
    packed = f"transform(slice(_hashes, 1, greatest(size(_hashes) - 2, 0)), (x, i) -> shiftleft(xxhash64(x, get(_hashes, i + 1), get(_hashes, i + 2)) & {hash_mask}L, _bits) | i)"
    out = out.withColumn("_packed", F.sort_array(_expr(packed)))
    same = "filter(_packed, (e, i) -> coalesce(shiftright(e, _bits) = shiftright(get(_packed, i - 1), _bits), false) or coalesce(shiftright(e, _bits) = shiftright(get(_packed, i + 1), _bits), false))"
    out = out.withColumn("_same", _expr(same))
    differ = " or ".join(f"get(_words, cast(e & _low as int) + {k}) <> get(_words, cast(get(_same, i + 1) & _low as int) + {k})" for k in range(3))
    clash = f"exists(transform(_same, (e, i) -> coalesce(shiftright(e, _bits) = shiftright(get(_same, i + 1), _bits) and ({differ}), false)), x -> x)"
    equal = lambda at: f"coalesce(e.a = get(s, {at}).a and e.b = get(s, {at}).b and e.c = get(s, {at}).c, false)"
    windows = "array_sort(transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> named_struct('a', w, 'b', get(_words, i + 1), 'c', get(_words, i + 2), 'i', i)))"
    by_words = f"get(transform(array({windows}), s -> transform(filter(s, (e, i) -> {equal('i - 1')} or {equal('i + 1')}), e -> cast(e.i as bigint))), 0)"
    out = out.withColumn("_again", F.sort_array(F.when(_expr(clash), _expr(by_words)).otherwise(_expr("transform(_same, e -> e & _low)"))))
    out = out.withColumn("n_repeat_words", _expr("aggregate(transform(_again, (p, i) -> least(3L, coalesce(get(_again, i + 1) - p, 3L))), 0L, (a, x) -> a + x)"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_lines", "_bits", "_low", "_packed", "_same", "_again")


def labelled_ids(labels: DataFrame) -> DataFrame:
    """(_id, _trusted): 1 for good and not toxic, 0 for bad, of all labelled documents. An id with
    labels of both kinds counts as bad."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return one.where("q = 0 or q = 1 and t = 0").select("_id", F.col("q").cast("int").alias("_trusted"))


def log_ratios(words: DataFrame) -> DataFrame:
    """One row with ``ratios``, the log ratio of each bucket in order, from rows with _hashes and _trusted."""
    grams = words.select(F.coalesce("_trusted", F.lit(0)).alias("t"), F.explode(_buckets()).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("good"))
    every = words.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0, ["raw", "good"])
    table = every.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "good"))).alias("m"), F.sum("raw").alias("raw"), F.sum("good").alias("good"))  # BUCKETS entries
    one = "ln((x.good + {a}) / (good + {n})) - ln((x.raw + {a}) / (raw + {n}))".format(a=f"{SMOOTHING}D", n=f"{SMOOTHING * BUCKETS}D")
    return table.select(_expr(f"transform(m, x -> {one})").alias("ratios"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base figures, base_failed, score, kept.

    Null text has no words; documents without n-grams score 0. Without trusted documents
    the threshold is 0 and scores are against a flat target. Repeated rows are judged
    alike. Other columns are not read. Long texts are judged whole; a score that equals the
    threshold is kept; an empty table gives no rows.
    """
    shared_root(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw"))
    known = labelled_ids(labels).checkpoint()
    # merged at every size, so that what is shuffled (the texts, once) grows as the input does
    ratios = log_ratios(with_words(rows.join(known.hint("merge"), "_id", "left"), "_raw")).checkpoint()  # one row, BUCKETS numbers
    scored = with_base(with_words(rows, "_raw").withColumn("ratios", ratios.scalar()))
    mean = _expr("aggregate(_grams, 0D, (a, b) -> a + get(ratios, b)) / size(_grams)")
    scored = scored.withColumn("_grams", _buckets()).withColumn("score", F.when(F.size("_grams") > 0, mean).otherwise(0.0))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"]
    narrow = scored.select("_id", *figures).checkpoint()
    judged = narrow.where(~F.col("base_failed")).select("_id", "score").join(known, "_id")
    at = quantiles(judged.checkpoint(), {"low": (F.when(F.col("_trusted") == 1, F.col("score")), TRUSTED_LOW), "high": (F.when(F.col("_trusted") == 0, F.col("score")), BAD_HIGH)})
    low, high = at["low"], at["high"]
    least = 0.0 if low is None else low if high is None else (low + high) / 2
    return narrow.select(F.col("_id").alias(id_col), *figures, (~F.col("base_failed") & (F.col("score") >= F.lit(least))).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
