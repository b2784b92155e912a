"""Token ids of a word-end BPE tokenizer, found for many texts at a time.

Texts are joined and cut into pieces (runs of letters, single digits, runs of symbols) by
array operations over their characters; equal pieces of a part are brought together first,
so that the tokenizer's model sees each new one once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pieces that one encoder keeps unless told otherwise (about 200 bytes each); beyond, the cache starts anew.
CACHED_PIECES = 350_000
#: Characters that are cut into pieces together, about.
PART_CHARS = 1 << 20
#: Letters below this code are normalised and lower-cased each on its own.
_PLAIN = 0x250
_SPACE, _LETTER, _NUMBER, _SYMBOL, _ODD = range(5)
_GAP = re.compile("[\t-\r ]")


class WordBpe:
    """Same ids as ``Tokenizer.encode(text, add_special_tokens=False)`` for a tokenizer that
    drops white space and splits into letters, digits and symbols.

    Words with characters from U+0250 on or the dotted capital I (normalisation and folding
    depend on more than the letter), with an apostrophe (the tokenizer has its own rule) or a
    ``<`` (its added tokens begin with it) go through the whole tokenizer as they are.
    """

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pieces: dict[bytes, bytes] = {}
        self.cached = cached
        by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        pieces = lambda text: len(self.whole.pre_tokenizer.pre_tokenize_str(text))
        self.kind, self.lower = np.full(1 << 16, _ODD, dtype=np.uint8), np.arange(1 << 16, dtype=np.uint16)
        self.as_bytes = {}
        for c in range(_PLAIN):
            s = chr(c)
            if s not in "İ'<":
                self.kind[c] = _SPACE if not pieces(s) else _LETTER if pieces("a" + s) == 1 else _SYMBOL if pieces("#" + s) == 1 else _NUMBER
                self.lower[c] = ord(s.lower())
            if self.kind[c] != _SPACE:
                self.as_bytes[c] = by_bytes.pre_tokenize_str(s)[0][0]
        self.kind_bytes, self.lower_bytes = self.kind[:256].tobytes(), self.lower[:256].astype(np.uint8).tobytes()
        for c in {*self.lower[:_PLAIN].tolist()} - {*range(_PLAIN)}:
            self.as_bytes[c] = by_bytes.pre_tokenize_str(chr(c))[0][0]

    def _learn(self, new: list[bytes], odd: list[bool], encoding: str) -> None:
        """Adds pieces to the cache; their ids are made into bytes together."""
        ids, ends = [], [0]
        for raw, whole in zip(new, odd, strict=True):
            piece = raw.decode(encoding)
            if whole:
                ids += self.whole.encode(piece, add_special_tokens=False).ids
            else:
                ids += [t.id for t in self.model.tokenize(piece if piece.isascii() and piece.isprintable() else piece.translate(self.as_bytes))]
            ends.append(4 * len(ids))
        flat = np.array(ids, dtype="<u4").tobytes()
        self.pieces.update((_key(raw, encoding), flat[a:b]) for raw, a, b in zip(new, ends, ends[1:], strict=False))

    def _part(self, texts: list[str]) -> list[bytes]:
        text = "\n".join(texts)
        try:
            raw, encoding = text.encode("latin-1"), "latin-1"
            sizes = [len(t) + 1 for t in texts]
            code, kind, low = (np.frombuffer(x, dtype=np.uint8) for x in (raw, raw.translate(self.kind_bytes), raw.translate(self.lower_bytes)))
        except UnicodeEncodeError:
            raw, encoding = text.encode("utf-16-le"), "utf-16-le"
            sizes = [len(t.encode("utf-16-le")) // 2 + 1 for t in texts]
            code = np.frombuffer(raw, dtype="<u2")
            kind, low = self.kind[code], self.lower[code]
        full = kind != _SPACE
        starts = full.copy()  # of words
        starts[1:] &= ~full[:-1]
        begins = kind == _NUMBER  # of pieces
        begins[1:] |= kind[1:] != kind[:-1]
        begins = begins & full | starts
        strange = kind == _ODD
        slow = np.zeros(0, dtype=np.int64)
        if strange.any():  # words with an odd character are one piece, in their own letters
            words = np.flatnonzero(starts)
            which = np.unique(np.searchsorted(words, np.flatnonzero(strange), side="right") - 1)
            slow = words[which]
            low = low.copy()
            for a, b in zip(slow.tolist(), np.append(words, len(code))[which + 1].tolist(), strict=True):
                begins[a + 1 : b] = False
                low[a:b] = code[a:b]
        at = np.flatnonzero(begins)
        letters = low[full]
        ends = np.append((np.cumsum(full, dtype=np.int32)[at] - 1) * code.itemsize, len(letters) * code.itemsize).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        keys = [_key(n, encoding) for n in names] if encoding != "latin-1" else names
        new = [i for i, k in enumerate(keys) if k not in self.pieces]
        if len(self.pieces) + len(new) > self.cached:
            self.pieces.clear()
            new = range(len(keys))
        if new:
            whole = np.zeros(len(names), dtype=bool)
            whole[pieces.indices.to_numpy()[np.searchsorted(at, slow)]] = True
            self._learn([names[i] for i in new], whole[new].tolist(), encoding)
        ids = pa.array(map(self.pieces.__getitem__, keys), pa.binary(), size=len(keys)).take(pieces.indices)
        _, ends, flat = ids.buffers()
        ends, flat = np.frombuffer(ends, dtype=np.int32), b"" if flat is None else flat.to_pybytes()
        cut = [0, *ends[np.searchsorted(at, np.cumsum(sizes))].tolist()]  # by the pieces before the end of each text
        return [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        held, chars = [], 0
        for text in texts:
            if len(text) > 2 * PART_CHARS:
                if held:
                    yield from self._part(held)
                    held, chars = [], 0
                yield b"".join(x for part in _cut(text) for x in self._part([part]))
                continue
            held.append(text)
            chars += len(text)
            if chars >= PART_CHARS:
                yield from self._part(held)
                held, chars = [], 0
        if held:
            yield from self._part(held)


def _key(raw: bytes, encoding: str) -> bytes:
    """A piece has a key in either encoding."""
    return raw if encoding == "latin-1" else raw + b"\xff"


def _cut(text: str) -> Iterator[str]:
    """A long text in parts that end at white space (one word stays whole, however long)."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PART_CHARS)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end
