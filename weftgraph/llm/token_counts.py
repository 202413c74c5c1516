"""Token counts by a linear longest-match automaton over a vocabulary trie."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokenizer import byte_letters, default_path


def vocabulary(path: str) -> set[bytes]:
    """The pieces of a byte-level tokenizer file as bytes, word-end marks and special tokens left out."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data["added_tokens"]}
    end = data["model"].get("end_of_word_suffix") or ""
    back = {c: b for b, c in byte_letters().items()}
    return {bytes(back[c] for c in t.removesuffix(end)) for t in data["model"]["vocab"] if t not in special} - {b""}


class LongestMatch:
    """Greedy longest-match piece counts of a word, in time linear in its length.

    Node 0 is the root.  ``fail[v]`` is the node to go on from once what ``v``
    spells cannot be extended, -1 if the word cannot be cut; ``popped[v]`` is how
    many whole pieces that step closes.  A word that cannot be cut counts as one
    unknown piece.
    """

    def __init__(self, pieces: Iterable[bytes]):
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node
        ends = {0: False}
        for piece in sorted(pieces):
            v = 0
            for b in piece:
                w = self.edges.get(v << 8 | b)
                if w is None:
                    w = self.edges[v << 8 | b] = len(ends)
                    ends[w] = False
                v = w
            ends[v] = bool(v)
        children: dict[int, list[tuple[int, int]]] = {}
        for key, w in self.edges.items():
            children.setdefault(key >> 8, []).append((key & 255, w))
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        level = [0]
        while level:
            below = []
            for v in level:
                for b, w in children.get(v, ()):
                    below.append(w)
                    if ends[w]:
                        self.fail[w], self.popped[w] = 0, 1
                        continue
                    n, z = self.popped[v], self.fail[v]
                    while z >= 0 and (z << 8 | b) not in self.edges:
                        n += self.popped[z]
                        z = self.fail[z]
                    self.popped[w], self.fail[w] = n, self.edges[z << 8 | b] if z >= 0 else -1
            level = below

    def count(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        v = n = 0
        for b in word:
            w = edges.get(v << 8 | b)
            while w is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return 1
                w = edges.get(v << 8 | b)
            v = w
        while v > 0:
            n += popped[v]
            v = fail[v]
        return n if v == 0 else 1


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, memo: int = 300_000) -> DataFrame:
    """One row per document: doc_id, n_words and n_tokens of its whole text.

    Words lie between ASCII white space, with A-Z lowered; each is cut greedily
    into the longest vocabulary pieces of its bytes.  Null and empty texts have
    none.  Repeated rows are counted alike, each in a row of its own; a null doc_id
    stays null; other columns are not looked at; an empty table gives an empty
    one.  The automaton grows with the vocabulary only; each worker memoises the
    counts of up to ``memo`` words of at most 64 bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary(tokenizer_path or default_path()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        automaton = LongestMatch(shared.value)
        for batch in batches:
            words_out, tokens_out = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode("utf-8", "replace").lower().split()
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = automaton.count(w)
                        if len(w) <= 64:
                            if len(known) >= memo:
                                known.clear()
                            known[w] = n
                    total += n
                words_out.append(len(words))
                tokens_out.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words_out, pa.int64()), pa.array(tokens_out, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long")


def brute_force(word: bytes, pieces: set[bytes]) -> int:
    """Greedy longest match by slicing, for tests."""
    longest = max(map(len, pieces))
    at = n = 0
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return 1
        at += size
        n += 1
    return n
