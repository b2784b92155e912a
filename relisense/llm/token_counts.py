"""Token counts of a unigram tokenizer by a count-only Viterbi pass.

An Aho-Corasick automaton over the vocabulary lists the pieces that end at each character;
per position only the best score, the number of pieces and whether the last piece is
unknown are kept. The rules are those of the ``tokenizers`` library's Unigram model: of
equal scores the longest last piece wins; a character that is no piece by itself may be an
unknown piece at the lowest score less ten; neighbouring unknown pieces count as one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN_PENALTY = 10.0
SPACE_MARK = "\u2581"
#: Words whose counts a Python worker keeps.
CACHED_WORDS = 1_000_000
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f" + SPACE_MARK + "]")


class UnigramCounter(dict):
    """Counts by word: white space parts words, each of which begins with the space mark."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.find = ahocorasick.Automaton()
        for piece, score in dict(reversed(vocab)).items():  # of a repeated piece the first score holds
            self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        n = self[word] = self.pieces(SPACE_MARK + word)
        return n

    def pieces(self, text: str) -> int:
        """Number of pieces on the best path through the whole text."""
        n = len(text)
        score, count, last = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at = 0  # characters done

        def step(end: int, found: list[tuple[int, float]]) -> None:
            best, single = None, False
            for size, s in found:  # longest first
                single |= size == 1
                x = score[end - size] + s
                if best is None or x > best:
                    best, count[end], last[end] = x, count[end - size] + 1, False
            if not single:
                x = score[end - 1] + self.unknown
                if best is None or x > best:
                    best, count[end], last[end] = x, count[end - 1] + (not last[end - 1]), True
            score[end] = best

        held: list[tuple[int, float]] = []
        for end, piece in self.find.iter(text):
            while at < end:
                at += 1
                step(at, held)
                held = []
            held.append(piece)
        while at < n:
            at += 1
            step(at, held)
            held = []
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if _ODD.search(text):
            words = [w for chunk in _SPACE.split(text) if chunk for i, w in enumerate(chunk.split(SPACE_MARK)) if w or i]
        else:
            words = text.split()
        return sum(map(self.__getitem__, words))


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with unigram scores by rank: -ln(place + 1), in file order.

    Control, unknown and byte pieces are left out.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [(p, -math.log(i + 1)) for i, p in enumerate(kept)]


_counters: dict[str, UnigramCounter] = {}


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens (0 for null and empty texts). Repeated rows and
    null ids stay; other columns are not read. Long texts are counted whole; among cuts of
    equal score the tokenizer's rule decides; an empty table gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if vocab_path not in _counters:
            _counters[vocab_path] = UnigramCounter(vocabulary(vocab_path))
        count = _counters[vocab_path].count
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "n_tokens": [count(t) for t in batch["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, n_tokens long").withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
