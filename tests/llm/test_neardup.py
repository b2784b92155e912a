import random

import pytest

from relisense.llm.graph import components
from relisense.llm.neardup import Limits, block_links, near_duplicates, shingle_set

from .conftest import prose


def brute(rows, k=3, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(n_chain=150):
    """A long chain of edits, a passage that most share, copies, and plain documents."""
    rng = random.Random(1)
    passage = prose(rng, 25)
    texts, t = [], prose(rng, 150).split()
    for _ in range(n_chain):
        t = list(t)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = prose(rng, 1) + str(rng.randrange(10**6))
        texts.append(" ".join(t))
    texts += [prose(rng, rng.randint(1, 60)) + " " + passage for _ in range(150)]
    texts += [texts[3]] * 4 + [None, "", "one two", "one two", "One TWO", "two one"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_against_brute_force(spark):
    rows = corpus()
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_five_words_and_eighty_percent(spark):
    rows = corpus(40)[:200]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words_each=5, percent=80).collect()
    expected = brute(rows, 5, 80)
    assert {r["doc_id"]: r["component_id"] for r in out} == {k: v[1] for k, v in expected.items()}


def test_odd_rows(odd, odd_rows, none):
    out = near_duplicates(odd).collect()
    assert len(out) == len(odd_rows)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[6]["component_id"] == by[7]["component_id"] == by[8]["component_id"] == 5
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[1]["kept"]
    assert all(r["component_id"] is None and not r["kept"] for r in out if r["doc_id"] is None)
    assert near_duplicates(none).count() == 0


def test_repeated_ids_are_texts_of_their_own(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(3, a), (3, b), (4, a + " x"), (5, b), (3, c), (2, c)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, out)) == sorted([(3, 3, True), (3, 3, True), (4, 3, False), (5, 3, False), (3, 2, False), (2, 2, True)])


def test_least_similarity(spark):
    rows = corpus(20)
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=75).collect()
    expected = brute(rows, 3, 75)
    assert {r["doc_id"]: r["component_id"] for r in out} == {k: v[1] for k, v in expected.items()}
    assert Limits(100).common_postings == 1
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=70)


def test_lists_of_many_blocks(spark, monkeypatch):
    """Several large groups of near copies, and classes beside them, that share their common values."""
    from relisense.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(9)
    passage, rows = prose(rng, 60), []
    for _ in range(3):
        body = passage + " " + prose(rng, 60)
        for _ in range(70):
            words = body.split()
            words[rng.randrange(60, 120)] = prose(rng, 1) + str(rng.randrange(10**6))
            rows.append(" ".join(words))
    rows += [passage + " " + prose(rng, rng.randint(1, 40)) for _ in range(80)] + [passage + " " + " ".join(prose(rng, 40).split()[:n]) for n in range(40)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {k: v[1] for k, v in brute(rows).items()}


def test_shingles_and_blocks():
    assert len(shingle_set("a b c a b c")) == 3
    assert len(shingle_set("a b")) == 1 and len(shingle_set(" \n")) == 0 and len(shingle_set(None)) == 0
    assert (shingle_set("A B C") == shingle_set("a  b\tc")).all()
    s = [shingle_set(t) for t in ("a b c d e f g h i j", "a b c d e f g h i j k", "z y x w")]
    assert block_links([7, 3, 9], s) == [(7, 3)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 700)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
