"""Token ids of whole texts by a public tokenizer, with a bounded memo of chunks.

The tokenizer drops white space and never joins across it, so the ids of a text
are those of its chunks between ASCII white space.  Chunks repeat, so each
worker keeps a bounded memo of them.
"""

from __future__ import annotations

import re

import numpy as np

#: Letters for which lower-casing, normal form and the split pattern are known to keep one piece.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"([{LETTERS}]*)([.,;:!?]*)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: printable Latin-1 stays, the rest follow from U+0100."""
    keeps = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in keeps]
    return {b: chr(b) for b in keeps} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class ChunkTokenizer(dict):
    """Ids of texts; as a dict, it is the memo from chunk to row of ``spans``.

    The memo holds ``limit`` chunks of at most 64 bytes (some 150 bytes each) and
    starts anew, between texts, when full.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model, self.table, self.limit = self.whole.model, byte_letters(), limit
        self._start()

    def _start(self) -> None:
        self.clear()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.spans = np.zeros((1 << 12, 2), np.int64)  # start in flat, length
        self.count = self.used = 0

    def _known(self, chunk: bytes) -> list[int]:
        row = self[chunk]  # may replace spans
        start, length = self.spans[row]
        return self.flat[start : start + length].tolist()

    def _ids(self, chunk: bytes) -> list[int]:
        """A word is cut by the model alone, a word with marks behind or capitals from its parts, all else by the whole tokenizer."""
        if chunk.isalpha() and chunk.islower():
            return [t.id for t in self.model.tokenize(chunk.decode())]
        text = chunk.decode("utf-8", "replace")
        plain = PLAIN.fullmatch(text)
        if plain is None:
            return self.whole.encode(text, add_special_tokens=False).ids
        word, marks = plain.groups()
        low = word.lower().encode()
        if low != chunk:
            return [*(self._known(low) if low else ()), *(self._known(marks.encode()) if marks and word else [t.id for t in self.model.tokenize(marks)] if marks else ())]
        return [t.id for t in self.model.tokenize(low.decode("latin-1").translate(self.table))]

    def __missing__(self, chunk: bytes) -> int:
        ids = self._ids(chunk)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        if self.count == len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = self.count
        self.spans[at] = self.used, len(ids)
        self.used += len(ids)
        self.count += 1
        if len(chunk) <= 64:
            self[chunk] = at
        return at

    def ids(self, text: str | None) -> np.ndarray:
        chunks = (text or "").encode("utf-8", "replace").split()
        if not chunks:
            return np.zeros(0, np.uint32)
        if self.count > self.limit:
            self._start()
        rows = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))  # may replace spans
        starts, lengths = self.spans[rows].T
        ends = np.cumsum(lengths)
        return self.flat[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)]


_made: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One per worker and file."""
    if path not in _made:
        _made[path] = ChunkTokenizer(path)
    return _made[path]


def release() -> None:
    """Drop this worker's tokenizers and memos: operators that cut no tokens call it, as Spark reuses workers between jobs."""
    _made.clear()
