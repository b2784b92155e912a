"""Decontamination, personal data and quality rules."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relisense.llm.decontaminate import leaks
from relisense.llm.pii import BASE_KINDS, _line, find_pii, redact
from relisense.llm.quality import BAD_HIGH, BUCKETS, SMOOTHING, TRUSTED_LOW, judge, with_base, with_words

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(s):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(s)))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]
CASES = [
    "a@b.c.@d.e.f x@y@z.org @@ a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 +1 (234) 555-7586 +12", "é☃ mail me: o'neil+x@ex-ample.co.uk, 4111111111111111", "9" * 5000, "+" + "1 " * 3000, "a." * 4000 + "@b", "1.1.1.1" * 50,
    "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, GB83WEST12345698765432", "tel: 030 1234 5678 but a second number, 030 1234 5678, is far from that word", "5500 0000 0000 0004 5500 0000 0000 0004", None, "",
]


def base_line(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, rx, ok in BASE for m in re.finditer(rx, text or "") if ok(m[0]))


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(2)
    alphabet = "a@.1 9-+(é5☃"
    rows = list(enumerate([*CASES, *["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(400)]]))
    found = find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    out = found.select("doc_id", _line(F.filter("_spans", lambda s: s["kind"].isin(*BASE_KINDS))).alias("base"), _line(F.col("_spans")).alias("all")).collect()
    text = dict(rows)
    for r in out:
        assert r["base"] == base_line(text[r["doc_id"]]), text[r["doc_id"]]
    more = {r["doc_id"]: r["all"] for r in out}
    assert more[8].count("iban:") == 2 and more[9].count("local_phone:") == 1


def test_redaction_keeps_columns(odd, spark):
    assert redact(odd).columns == odd.columns and redact(odd).count() == odd.count()
    one = redact(spark.createDataFrame([(1, "x a@b.cd y 1.2.3.4", 19)], "doc_id long, text string, n_chars long")).first()
    assert (one["text"], one["n_chars"]) == ("x [EMAIL] y [IP]", 16)
    assert redact(spark.createDataFrame([(1, None, 0)], "doc_id long, text string, n_chars long")).first()["text"] is None


def test_iban_ends_where_its_country_says(spark):
    texts = ["IBAN BE68 5390 0754 7034 BIC KREDBEBB", "BE68 5390 0754 7034 2024", "DE89370400440532013000 X", "BE68539007547035", "ZZ68 5390 0754 7034", "NO93 8601 1117 947"]
    found = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", F.filter("_spans", lambda s: s["kind"] == "iban").alias("s")).collect()
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["s"]] for r in found}
    assert got == {0: ["BE68 5390 0754 7034"], 1: ["BE68 5390 0754 7034"], 2: ["DE89370400440532013000"], 3: [], 4: [], 5: ["NO93 8601 1117 947"]}


def test_columns_of_any_name_stay(spark):
    rows = [(1, "me@x.org", "own text", "own spans", "any", "r", "dotted")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _spans string, _any string, _row string, `a.b` string")
    assert redact(docs).first() == (1, "[EMAIL]", *rows[0][2:]) and redact(docs).columns == docs.columns
    found = find_pii(docs, spans_col="found")
    assert found.drop("found").first() == rows[0] and len(found.first()["found"]) == 1


def test_leaks_tolerate_substitutions(spark, odd, none):
    rng = random.Random(3)
    item = prose(rng, 40)
    words = item.split()
    changed = list(words)
    for i in range(3, 40, 7):
        changed[i] = "zzz"
    docs = [(0, prose(rng, 200)), (1, prose(rng, 50) + " " + item + " " + prose(rng, 9)), (2, " ".join(changed)), (3, prose(rng, 30) + "\n" + " ".join(words[10:26]).upper() + "!"), (4, " ".join(rng.sample(words, 40))), (5, None), (6, ""), (1, item), (None, item)]
    bench = spark.createDataFrame([(7, item), (7, item), (8, "too short"), (9, None), (None, item)], "item_id long, text string")
    rows = leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 7), (2, 7), (3, 7)} and len(rows) == 3
    assert leaks(none, bench).count() == 0 and leaks(odd, bench).count() == 0
    assert leaks(odd, bench.limit(0)).count() == 0


def base_figures(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_base_figures(odd, odd_rows, none, no_labels):
    out = judge(odd, no_labels).collect()
    assert len(out) == len(odd_rows) and judge(none, no_labels).count() == 0
    text = {r[0]: r[1] for r in odd_rows if r[0] is not None}
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_figures(text[r["doc_id"]])
            assert not (r["base_failed"] and r["kept"])


def test_repeats(spark, no_labels):
    texts = ["a b c a b c", "a a a a a a a", "x y z " * 40, "l1 w\nl1 w\n\n \nl1 w ", "a b c d\r\ne\x0bf\x0cg # | <&>"]
    out = judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), no_labels).collect()
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_figures(texts[r["doc_id"]])


def test_repeats_are_exact_when_hashes_collide(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 2, 3, 5, 20, 60, 300)] + [prose(rng, 200)]
    rows = with_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for mask in (0, 3, -1):
        for r in with_base(rows, mask).collect():
            assert r["n_repeat_words"] == base_figures(texts[r["doc_id"]])[4]


def verdicts(rows, labels):
    """Scores and verdicts from the definition, with the same hashes."""
    import struct

    import numpy as np
    from xxhash import xxh64_intdigest as hashed

    signed = lambda x: struct.pack("<Q", x)

    def buckets(text):
        h = [hashed(w.encode(), 42) for w in WORD.findall(text or "")]
        number = lambda x: (x - (1 << 64) if x >> 63 else x) % BUCKETS
        return [number(x) for x in h] + [number(hashed(signed(b), hashed(signed(a), 42))) for a, b in zip(h, h[1:], strict=False)]

    grams = {i: buckets(t) for i, t in rows}
    good = {i for i, q, t in labels if q == 1 and not t}
    n = {True: Counter(), False: Counter()}
    for i, g in grams.items():
        n[False].update(g)
        n[True].update(g if i in good else [])
    part = lambda side, b: np.log((n[side][b] + SMOOTHING) / (sum(n[side].values()) + SMOOTHING * BUCKETS))
    ratio = {b: part(True, b) - part(False, b) for b in n[False]}
    score = {i: sum(ratio[b] for b in g) / len(g) if g else 0.0 for i, g in grams.items()}
    failed = {i: base_figures(t)[5] for i, t in rows}
    low = np.quantile([score[i] for i in good if not failed[i]], TRUSTED_LOW)
    high = np.quantile([score[i] for i, q, _ in labels if q == 0 and not failed[i]], BAD_HIGH)
    return {i: (score[i], not failed[i] and score[i] >= (low + high) / 2) for i, _ in rows}


def test_verdict_equals_brute_force(spark):
    """Tied scores (equal texts) get one verdict, on whichever side of the threshold they fall."""
    rng = random.Random(21)
    clean = [prose(rng, rng.randint(55, 90)) for _ in range(60)]
    mixed = [" ".join(w if rng.random() < 0.6 else w + "@@" for w in prose(rng, 70).split()) for _ in range(40)]
    rows = list(enumerate([*clean, *mixed, mixed[0], clean[0], None, "", prose(rng, 10)]))
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(i, 0, 0) for i in range(60, 100, 2)] + [(1, 1, 1)]
    out = judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    expected = verdicts(rows, labels)
    for r in out:
        score, kept = expected[r["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["kept"] == kept
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert kept[100] == kept[60] and kept[101] == kept[0] and 0 < sum(kept.values()) < len(rows) - 5


def test_verdict_separates_junk(spark):
    rng = random.Random(4)
    clean = [(i, prose(rng, 150)) for i in range(120)]
    junk = [(i, " ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in prose(rng, 150).split())) for i in range(120, 160)]
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(i, 0, 0) for i in range(120, 160, 2)]
    out = judge(spark.createDataFrame(clean + junk, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r["doc_id"] for r in out.where("kept").collect()} == set(range(120))


def test_base_digest(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_many_spans_in_one_text(spark):
    n = 3000
    pieces = [f"user{i}@host{i}.org" if i % 3 else f"call +49 30 {1000000 + i}" for i in range(n)]
    text = " é ".join(pieces)
    found = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["_spans"]
    at, want = 0, []
    for i, p in enumerate(pieces):
        skip = 0 if i % 3 else len("call ")
        want.append(("email" if i % 3 else "phone", at + skip, at + len(p)))
        at += len(p) + 3
    assert [(s["kind"], s["start"], s["end"]) for s in found if s["kind"] in ("email", "phone")] == sorted(want, key=lambda s: (s[0] == "phone", s[1]))
    assert all(s["score"] == pytest.approx(0.8) for s in found if s["kind"] == "phone")  # the word before each
    redacted = redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert redacted == " é ".join("[EMAIL]" if i % 3 else "call [PHONE]" for i in range(n))


def test_all_labelled_documents_count(spark):
    """More labels than any fixed number: every trusted document is in the counts and in the threshold."""
    from relisense.llm.quality import labelled_ids

    labels = spark.range(50_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 10 = 1 as int) as toxic")
    got = {r["_trusted"]: r["count"] for r in labelled_ids(labels).groupBy("_trusted").count().collect()}
    assert got == {1: 20_000, 0: 25_000}
    many = spark.range(60_000).selectExpr("id as doc_id", "cast(1 as int) as quality", "cast(0 as int) as toxic")
    assert labelled_ids(many).count() == 60_000
