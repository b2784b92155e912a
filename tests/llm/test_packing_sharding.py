import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from relisense.llm.packing import assign, capacities, pack
from relisense.llm.sharding import permute, row_of, shard_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("lengths", [[], [1], [4096], [5000, 3, 4096, 8192, 1, 1], [7] * 3000, list(range(1, 400))])
def test_assign_places_every_token_once(lengths):
    out = assign(lengths)
    room = defaultdict(int)
    seen = defaultdict(list)
    for d, start, n, s, offset in out:
        seen[d].append((start, n))
        assert offset == room[s]
        room[s] += n
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[d]):
            assert start == at
            at += k
        assert at == n
    assert sorted(room.values()) == sorted(capacities(sum(lengths)))
    assert all(n == 4096 or n & (n - 1) == 0 for n in room.values())


def test_costs_are_balanced():
    lengths = [4000] * 10 + [90] * 1000
    cost = defaultdict(float)
    for _, _, n, s, _ in assign(lengths):
        cost[s] += n + n * n / 2048
    assert max(cost.values()) < 12500


def test_pack_ids_equal_the_tokenizer(odd, odd_rows):
    whole = Tokenizer.from_file(PATH)
    expected = defaultdict(list)
    for r in odd_rows:
        expected[r[0]].append(np.array(whole.encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes())
    rows = pack(odd, PATH, block_tokens=9000).collect()
    total = sum(len(x) for v in expected.values() for x in v)
    assert sum(len(r["ids"]) for r in rows) == total
    for k in {k for k, v in expected.items() if len(v) == 1}:
        mine = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == k)
        assert b"".join(x for _, x in mine) == expected[k][0]
    assert all(r["length"] * 4 == len(r["ids"]) for r in rows)


def test_empty_tables(none):
    assert pack(none, PATH).count() == 0
    assert shard_rows(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(n):
    x = permute(np.arange(n), n, seed=3)
    assert sorted(x) == list(range(n))
    assert (permute(x, n, seed=3, back=True) == np.arange(n)).all()


def test_shards(odd, odd_rows):
    rows = shard_rows(odd, n_shards=4, seed=9).collect()
    assert len(rows) == len(odd_rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert row_of(r["shard"], r["slot"], len(rows), 4, 9) == r["row_no"]
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {r[0]: (r[1] or "").encode() for r in odd_rows if r[0] is not None}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
    again = shard_rows(odd.repartition(3), n_shards=4, seed=9).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))  # the layout of the input does not matter
