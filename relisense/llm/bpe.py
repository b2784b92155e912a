"""BPE encoding and decoding with a contiguous rank array per word.

A text is normalised and cut into pieces (runs of letters, single digits, runs of symbols);
a piece starts as single characters, the last one with the end mark. Merging holds the
places of its parts' boundaries and, beside each inner boundary, the rank of the merge that
would delete it. The least rank is searched by a scan, the leftmost of equal ones, its
boundary goes, and only the ranks on either side are looked up anew. Scanning is quadratic
in the length of a piece, so pieces beyond SHORT_WORD characters keep their ranks in a heap
and give the same parts.

Ids equal those of the ``tokenizers`` library for a BPE file with an end-of-word suffix;
only its normaliser and its splitting rules are used here, for words with unusual letters.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from relisense.llm.tokens import WordBpe, _key

#: Pieces of up to so many characters are merged by scans over the rank array.
SHORT_WORD = 128
#: Rows that are encoded or decoded together, at most.
ROWS_AT_ONCE = 500
#: The rank of two parts that no merge joins; greater than any merge's.
NO_MERGE = 1 << 30


class RankArrayBpe(WordBpe):
    """Ids of texts (see WordBpe for how they are cut into pieces), merged by rank arrays."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: only plain BPE with an end-of-word suffix is known here")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def parts(self, piece: str) -> list[str]:
        """The piece (in the vocabulary's alphabet), cut where no merge is left."""
        if len(piece) > SHORT_WORD:
            return self._parts_of_long(piece)
        word, rank = piece + self.end, self.rank.get
        bounds = [*range(len(piece)), len(word)]
        ranks = [rank((word[a:b], word[b:c]), NO_MERGE) for a, b, c in zip(bounds, bounds[1:], bounds[2:], strict=False)]
        while ranks and (least := min(ranks)) < NO_MERGE:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((word[bounds[i - 1] : bounds[i]], word[bounds[i] : bounds[i + 1]]), NO_MERGE)
            if i < len(ranks):
                ranks[i] = rank((word[bounds[i] : bounds[i + 1]], word[bounds[i + 1] : bounds[i + 2]]), NO_MERGE)
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _parts_of_long(self, piece: str) -> list[str]:
        """The same by a heap of (rank, place): n log n steps."""
        word, n = piece + self.end, len(piece)
        after = [*range(1, n), len(word), -1]  # by the start of a part: where it ends, which is where the next one starts
        after_of = lambda at: after[at] if at < n else -1
        before = [*range(-1, n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def push(a: int) -> None:
            b = after_of(a)
            c = after_of(b)
            if c > 0 and (k := self.rank.get((word[a:b], word[b:c]))) is not None:
                heapq.heappush(heap, (k, a, b, c))

        for a in range(n):
            push(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if after_of(a) != b or after_of(b) != c:
                continue  # one of the two has been merged meanwhile
            after[a], after[b] = c, -1
            if c < n:
                before[c] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        out, a = [], 0
        while a < n:
            out.append(word[a : after[a]])
            a = after[a]
        return out

    def _ids(self, piece: str) -> list[int]:
        return [self.vocab[p] for p in self.parts(piece)]

    def _odd_ids(self, word: str) -> list[int]:
        """Of a word as it stands in the text: added tokens first, the rest normalised and split by the file's rules."""
        out: list[int] = []
        for part in self.at_added.split(word) if self.at_added else [word]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(part)):
                    out += self._ids(piece)
        return out

    def _learn(self, new: list[bytes], odd: list[bool], encoding: str) -> None:
        for raw, whole in zip(new, odd, strict=True):
            piece = raw.decode(encoding)
            ids = self._odd_ids(piece) if whole else self._ids(piece if piece.isascii() and piece.isprintable() else piece.translate(self.as_bytes))
            self.pieces[_key(raw, encoding)] = np.array(ids, dtype="<u4").tobytes()

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """list<int32> for a column of texts; null is empty."""
        flat = [*self.encode(["" if t is None else t for t in texts.to_pylist()])]
        offsets = np.zeros(len(flat) + 1, dtype=np.int32)
        np.cumsum([len(x) // 4 for x in flat], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(flat), dtype="<i4")))


class TokenTable:
    """What stands for ids: their tokens, joined by one space, as a tokenizer file without a decoder has it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file.get("decoder"):
            raise ValueError(f"{path}: has a decoder of its own, which is not known here")
        by_id = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.tokens = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())

    def decode_column(self, ids: pa.Array) -> pa.Array:
        """string for a column of list<int32>; null is empty, unknown and null ids are left out."""
        rows = pc.list_parent_indices(ids)
        flat = ids.flatten()
        tokens = self.tokens.take(pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.tokens))), flat, pa.scalar(None, flat.type)))
        known = tokens.is_valid()
        if tokens.null_count:
            rows, tokens = rows.filter(known), tokens.filter(known)
        counts = np.bincount(rows.to_numpy(zero_copy_only=False), minlength=len(ids))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens), " ")


def _with_column(df: DataFrame, read: str, name: str, kind, made, keep: list[str] | None) -> DataFrame:
    """df (or the columns named in keep) with one more column, made batch by batch from the column ``read``.

    The read column travels as the last one under a name that no other can have, so that
    columns of any name, repeated ones too, pass through.
    """
    kept = [(i, f) for i, f in enumerate(df.schema.fields) if f.name != name and (keep is None or f.name in keep)]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    source = plain[f"c{df.columns.index(read)}"]
    sent = plain.select(*[plain[f"c{i}"] for i, _ in kept], source.alias("read"))
    schema = StructType([*[StructField(f"c{i}", f.dataType, True) for i, f in kept], StructField("made", kind, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = made()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], step(b.column(b.num_columns - 1))], names=[*b.schema.names[:-1], "made"])
        pa.default_memory_pool().release_unused()

    return sent.mapInArrow(run, schema).toDF(*[f.name for _, f in kept], name)


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """docs with one more column, array<int>: the ids of each text without special tokens around them.

    A null or empty text, or one of white space alone, has no ids; texts are encoded whole,
    whatever their length (a task holds ROWS_AT_ONCE of them); repeated rows, nulls and
    columns of any name stay as they are; only a column that is itself called ``ids_col`` is
    replaced. Of equal ranks the leftmost is merged first. The strings of added tokens in a
    text are those tokens. keep: columns of docs that are wanted, all if None. An empty table
    gives no rows.
    """
    return _with_column(docs, text_col, ids_col, ArrayType(IntegerType()), lambda: RankArrayBpe(tokenizer_path).encode_column, keep)


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """rows with one more column, string: what the ids stand for, special tokens included.

    Null or no ids give an empty text; ids that the tokenizer hasn't, and nulls, are left
    out; further columns as in ``encode``. An empty table gives no rows.
    """
    return _with_column(rows, ids_col, text_col, StringType(), lambda: TokenTable(tokenizer_path).decode_column, keep)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, keep=["doc_id"])
    both = decode(encoded, path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
