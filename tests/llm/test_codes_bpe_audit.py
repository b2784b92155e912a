"""Vector codes, BPE encoding and decoding, and the audit of filters."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from relisense.llm import bpe, filter_audit, vector_codes

from .conftest import prose

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


# --- vector codes


def plain_nearest(row, book):
    return min(range(len(book)), key=lambda j: (sum((int(a) - int(b)) ** 2 for a, b in zip(row, book[j])), j))


def plain_codes(rows, rounds=2, entries=64):
    """(codes by row, errors, books) for (id, integral vector) by the definition."""
    width = len(rows[0][1]) // 16
    cut = lambda v: [v[i : i + width] for i in range(0, len(v), width)]
    first = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    books = [[cut(v)[p] for _, v in first] for p in range(16)]
    for _ in range(rounds):
        for p in range(16):
            fall = {}
            for _, v in rows:
                fall.setdefault(plain_nearest(cut(v)[p], books[p]), []).append(cut(v)[p])
            for e, xs in fall.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    codes = [[plain_nearest(cut(v)[p], books[p]) for p in range(16)] for _, v in rows]
    errors = [sum(sum((a - b) ** 2 for a, b in zip(cut(v)[p], books[p][c[p]])) for p in range(16)) for (_, v), c in zip(rows, codes)]
    return ["".join(f"{x:02x}" for x in c) for c in codes], errors, books


@pytest.mark.parametrize("spread", [2, 40, 1000])
def test_partial_distances_find_the_nearest(spread):
    rng = np.random.default_rng(spread)
    for k, dims in ((1, 4), (7, 1), (64, 4), (64, 9)):
        rows, book = rng.integers(-spread, spread, (300, dims)), rng.integers(-spread, spread, (k, dims))
        book[k // 2] = book[0]  # ties
        at, distance = vector_codes.nearest(rows, book)
        want = [plain_nearest(r, book) for r in rows]
        assert at.tolist() == want
        assert distance.tolist() == [int(((r - book[j]) ** 2).sum()) for r, j in zip(rows, want)]


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)], i % 3 if i % 5 else None) for i in range(150)]
    rows += [(7, rows[7][1], 1), (None, rows[3][1], 2), (200, rows[3][1], None), (200, rows[4][1], None)]
    odd = [(300, None, 1), (301, [None] * 32, 1), (302, [1.0] * 31 + [float("nan")], 1), (303, [float("inf")] + [0.0] * 31, 1), (304, [], 1), (305, [1.0] * 16, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(5).withColumn("code", F.lit("?")).withColumn("id", F.lit(0))
    coded, books = vector_codes.compress(table, keep=("label",))
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in vector_codes.with_label_error(coded).collect()))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows]
    codes, errors, want = plain_codes(whole)
    by = Counter()
    for (_, _, label), e in zip(rows, errors):
        by[label] += e
    assert books.tolist() == want
    assert got == sorted((i is None, i or 0, c, e, by[label]) for (i, _, label), c, e in zip(rows, codes, errors))


def test_codes_of_few_or_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = vector_codes.compress(none, keep=("label",))
    assert books is None and vector_codes.with_label_error(coded).count() == 0
    coded, books = vector_codes.compress(spark.createDataFrame([(5, [0.5] * 16, 1)], none.schema))
    assert coded.first()["code"] == "00" * 16 and coded.first()["error"] == 0 and books.shape == (16, 1, 1)
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(5, [1e30] * 16, 1)], none.schema))[0].count()


# --- BPE


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_round_trip_equals_the_library(spark, odd, odd_rows, library, none):
    rng = random.Random(8)
    alphabet = "abcdefghij  ,.!'<|>0123 éßΣİǅ日本́  🙂"
    more = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [prose(rng, 3000), "a<|endoftext|>b <|startoftext|><|endoftext|> <|endoftext", "HELLO it's we'll 'S"]
    rows = odd_rows + [(1000 + i, t, *[None] * 8) for i, t in enumerate(more)]
    encoded = bpe.encode(spark.createDataFrame(rows, odd.schema).withColumn("ids", F.lit("?")), PATH)
    assert set(encoded.columns) == {*odd.columns, "ids"}
    got = bpe.decode(encoded, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(none, PATH), PATH).count() == 0


def test_scan_and_heap_give_the_same_parts():
    b = bpe.RankArrayBpe(PATH)
    rng = random.Random(4)
    for n in (1, 2, 3, 10, 60, 128):
        for letters in ("a", "ab", "thein", "abcdefghijklmnopqrstuvwxyz"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert b.parts(word) == b._parts_of_long(word)


def test_one_word_of_a_million_letters(spark, library):
    rng = random.Random(6)
    word = "".join(rng.choice("theinra") for _ in range(1_000_000))
    ids = bpe.encode(spark.createDataFrame([(word,)], "text string"), PATH, keep=[]).first()["ids"]
    assert list(ids) == library.encode(word, add_special_tokens=False).ids


def test_decoding_leaves_out_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [320, None, -1, 99999, 49407]), (2, []), (3, None)], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(rows, PATH, keep=["k"]).collect()}
    t = tokenizers.Tokenizer.from_file(PATH)
    assert got == {1: f"{t.id_to_token(320)} <|endoftext|>", 2: "", 3: ""}


# --- audit of filters


def plain_audit(docs, labels):
    import re

    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and first[text] < i,
        }
        mine = [x for x in labels if x[0] is not None and x[0] == i]
        rows.append((part or "", fails, any(q == 1 for _, q, _ in mine), any(t == 1 for _, _, t in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = here
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(r[1][f] for r in here) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def test_audit_equals_every_order(spark):
    rng = random.Random(12)
    texts = [None, "", "short text", "W" * 30, " ".join("word" for _ in range(80)), *[prose(rng, n) for n in (30, 60, 60, 90, 4000)]]
    texts += [t + " #" for t in texts[5:8]] + [t.upper() for t in texts[5:9]]
    docs = [(i if i % 11 else None, rng.choice(texts), rng.choice(["a", "a", "a", "b", None])) for i in range(160)] + [(40, texts[6], "b"), (40, texts[6], "b"), (500, prose(rng, 70), "clean")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 170, 2)] + [(4, 1, 0), (None, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("?") for c in ("part", "key", "first", "A", "good", "state", "_e")})
    got = filter_audit.audit(table.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    assert len(rows) == 600 * 4
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in rows} == plain_audit(docs, labels)


def test_audit_of_nothing(spark, none):
    assert filter_audit.audit(none).count() == 0
