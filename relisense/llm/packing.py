"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Every partition of the input is packed on its own (no shuffle), in blocks of a bounded
number of tokens. In a block, pieces go in descending length to the sequence with the
lowest cost so far (linear in the tokens plus quadratic in each piece, since attention
stays inside a document) among those with enough room; a piece that no sequence can hold
is cut over the sequences with most room. The capacity of a block is exactly its number
of tokens: full sequences, then a tail of powers of two, so that nothing is padded.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relisense.llm.shared import give_back, in_parts, small_batches
from relisense.llm.tokens import WordBpe

SEQ_LEN, END_ID = 4096, 2
#: Cost of n tokens of one piece: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens that are packed together at most; bounds the memory of a task.
BLOCK_TOKENS = 1_500_000
#: Pieces whose ids a task keeps: fewer than an encoder would, as a block is held besides.
CACHED_PIECES = 120_000
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def capacities(tokens: int, seq_len: int = SEQ_LEN) -> list[int]:
    """Sequence lengths that hold exactly so many tokens: full ones, then powers of two."""
    full, rest = divmod(tokens, seq_len)
    return [seq_len] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these lengths.

    Documents longer than a sequence are cut at multiples of it first. Ties: lower cost,
    then lower sequence number; pieces of equal length in document order. Empty documents
    give no piece.
    """
    room = capacities(sum(lengths), seq_len)
    pieces = sorted(((min(seq_len, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, seq_len)), key=lambda p: (-p[0], p[1], p[2]))
    used = [0] * len(room)
    cost = [0.0] * len(room)
    open_, parked = [(0.0, s) for s in range(len(room))], []  # parked: too little room for the current length
    out = []

    def put(n: int, d: int, start: int, s: int) -> None:
        out.append((d, start, n, s, used[s]))
        used[s] += n
        room[s] -= n
        cost[s] += LINEAR * n + QUADRATIC * n * n

    for n, d, start in pieces:
        while parked and -parked[0][0] >= n:  # lengths descend, so what was parked may fit again
            s = heapq.heappop(parked)[1]
            heapq.heappush(open_, (cost[s], s))
        while open_:
            _, s = heapq.heappop(open_)
            if room[s] >= n:
                put(n, d, start, s)
                if room[s]:
                    heapq.heappush(open_, (cost[s], s))
                break
            heapq.heappush(parked, (-room[s], s))
        else:  # nothing holds it whole
            while n:
                s = heapq.heappop(parked)[1]
                take = min(n, room[s])
                put(take, d, start, s)
                n, start = n - take, start + take
                if room[s]:
                    heapq.heappush(parked, (-room[s], s))
    return out


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    ids holds the piece's token ids as little-endian unsigned 32-bit numbers. Null and
    empty texts are documents of the end id alone; repeated rows and null ids are packed
    like any other; columns beside the two named are not read; an empty table gives no
    rows. Sequence ids are unique over the partitions, not gapless. A retried task packs
    its partition as before, since all it uses is that partition in its order.
    """
    end = struct.pack("<I", end_id)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bpe, next_sequence = WordBpe(tokenizer_path, CACHED_PIECES), TaskContext.get().partitionId() << 40
        names: list = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal next_sequence
            rows = assign([len(x) // 4 for x in texts], seq_len)
            frame = pd.DataFrame(rows, columns=["doc", "start", "length", "sequence", "offset"], dtype=np.int64)
            at = frame["doc"].to_numpy()
            out = pd.DataFrame({"doc_id": pd.array([names[i] for i in at], dtype="Int64"), "start": frame["start"], "length": frame["length"], "doc_tokens": np.array([len(x) // 4 for x in texts], dtype=np.int64)[at], "sequence_id": frame["sequence"] + next_sequence, "offset": frame["offset"]})
            out["ids"] = [texts[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in rows]
            next_sequence += len(capacities(held, seq_len))
            names.clear()
            texts.clear()
            return out

        for batch in in_parts(batches):
            for name, ids in zip(batch["id"].tolist(), bpe.encode(batch["text"].tolist()), strict=True):
                names.append(None if pd.isna(name) else int(name))
                texts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= block_tokens:
                    yield flush()
                    give_back()
                    held = 0
        if texts:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, PIECES)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
