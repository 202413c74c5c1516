"""Byte-level BPE by replaying merges over a corpus, and its inverse.

A block of texts is cut into words once; the words that are new make one
sequence of bytes.  An inverted index from merged token to the positions whose
pair makes it is then worked off in rank order: each merge visits its positions
only and enters the pairs with its two neighbours.  No word is encoded alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLOCK = 1 << 21  # characters whose words are replayed together
STEP = 1 << 16  # ids that are decoded or written together


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ranks, which are their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def class_ranges(pattern: str, top: int) -> str:
    """The code points below ``top`` that tiktoken's own matcher takes for the class ``pattern``, as ranges of a character class."""
    import tiktoken

    every = "".join(map(chr, [*range(min(top, 0xD800)), *range(0xE000, top)]))
    found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}).encode_ordinary(every)
    at = np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    return "".join(f"\\U{at[a]:08x}-\\U{at[b - 1]:08x}" for a, b in zip(starts, [*starts[1:], len(at)], strict=True))


def changes(x: np.ndarray) -> np.ndarray:
    """Whether each element differs from the one before; the first does."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


class Splitter:
    """Cuts texts into segments at sure word borders, and those into words by the tokenizer's pattern.

    The pattern's classes are spelled out as tiktoken's Unicode version has them,
    up to the first of ``TOPS`` that a text stays below: short classes match fast.
    """

    TOPS = (0x500, 0x10000, 0x110000)
    CLASSES = re.compile(r"\\[pP]\{\w+\}|\\[sS]|\\.|\[\^?|\]|.", re.DOTALL)

    def __init__(self, pattern: str):
        self.pattern, self.made = pattern, {}
        self.border = re.compile(r"(?<=[^\x09-\x0d ])(?=[\x09-\x0d ])")

    def compiled(self, top: int) -> re.Pattern:
        if top not in self.made:
            out, inside = [], False
            for part in self.CLASSES.findall(self.pattern):
                if part[:2] in (r"\p", r"\s"):
                    ranges = class_ranges(part, top)
                    out.append(ranges if inside else f"[{ranges}]")
                elif part[:2] in (r"\P", r"\S"):
                    if inside:
                        raise ValueError(f"{part} inside a class is not supported")
                    out.append(f"[^{class_ranges(part[:1] + part[1:].replace('P', 'p', 1).replace('S', 's', 1), top)}]")
                else:
                    inside = part[0] == "[" or inside and part != "]"
                    out.append(part)
            self.made[top] = re.compile("".join(out))
        return self.made[top]

    def words(self, text: str, block: int = BLOCK) -> Iterator[list[str]]:
        """The words of a text in order, a list for some ``block`` characters.

        A word holds either white space or none, but for one blank before it, so
        each place where white space follows something else is a border.
        """
        lead = int(np.frombuffer(text.encode(), np.uint8).max(initial=0))  # of a character's UTF-8
        find = self.compiled(self.TOPS[(lead >= 0xD4) + (lead >= 0xF0)]).findall
        at = 0
        while at < len(text):
            cut = self.border.search(text, at + block)
            end = cut.start() if cut else len(text)
            yield find(text[at:end] if at or cut else text)
            at = end


class Codec:
    """Encodes and decodes texts; new words are replayed by block, known ones come from a bounded memo.

    The memo holds ``limit`` words of at most 64 characters and their ids; it
    starts anew, between blocks, when full.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 300_000):
        self.ranks, self.limit, self.split = ranks, limit, Splitter(pattern)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        # Every pair of pieces that makes a piece, sorted, and what it makes.
        made = sorted((ranks[p[:k]] << 32 | ranks[p[k:]], r) for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks)
        self.pairs, self.makes = (np.array([x[i] for x in made] + last, np.int64) for i, last in ((0, [1 << 62]), (1, [-1])))
        self._start()

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.spans, self.count = np.zeros((1 << 12, 2), np.int64), 0

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair merges into, -1 if nothing."""
        keys = a << 32 | b
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.makes[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has.

        The lowest rank that any pair has is merged next, at all its positions from
        left to right.  Should a merge bring up a rank below its own, its word is
        merged alone at the end, as the order within it would differ.  Some 60 bytes
        a byte of the words are held.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        ids = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lengths] = -1, -1
        makes = np.full(n, -1, np.int64)
        inner = np.flatnonzero(after >= 0)
        makes[inner] = self._merged(ids[inner], ids[inner + 1])
        found = np.flatnonzero(makes >= 0)
        found = found[np.argsort(makes[found], kind="stable")]
        firsts = np.flatnonzero(changes(makes[found]))
        index: dict[int, list[np.ndarray]] = {int(makes[part[0]]): [part] for part in np.split(found, firsts[1:]) if len(part)}
        ranks, odd = sorted(index), []
        while ranks:
            rank = heapq.heappop(ranks)
            at = index.pop(rank)
            left = np.sort(at[0] if len(at) == 1 else np.concatenate(at))
            left = left[(makes[left] == rank) & changes(left)]
            if not len(left):
                continue
            right = after[left]
            if (right[:-1] == left[1:]).any():  # a run such as aaaa: every other pair
                taken, last = np.ones(len(left), bool), -1
                for i, (p, q) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
                    taken[i] = p != last
                    last = q if taken[i] else -1
                left, right = left[taken], right[taken]
            last = after[right]
            touching = np.flatnonzero(last[:-1] == left[1:])
            if len(touching):  # what stands between the two merges for a moment
                moment = self._merged(np.full(len(touching), rank), ids[left[touching + 1]])
                odd.append(left[touching[(moment >= 0) & (moment < rank)]])
            ids[left] = rank
            makes[left] = makes[right] = ids[right] = -1
            after[left] = last
            open_ = last >= 0
            before[last[open_]] = left[open_]
            first = before[left]
            near = np.concatenate([left[open_], first[first >= 0]])
            made = self._merged(ids[near], ids[after[near]])
            makes[near] = made
            good = made >= 0
            if not good.any():
                continue
            near, made = near[good], made[good]
            if (low := made < rank).any():
                odd.append(near[low])
            order = np.argsort(made, kind="stable")
            near, made = near[order], made[order]
            starts = np.flatnonzero(changes(made)).tolist()
            for a, b in zip(starts, [*starts[1:], len(near)], strict=True):
                m = int(made[a])
                if m not in index:
                    index[m] = []
                    heapq.heappush(ranks, m)
                index[m].append(near[a:b])
        left = np.flatnonzero(ids >= 0)
        counts = np.diff(np.searchsorted(left, np.concatenate([[0], ends])))
        if odd and len(bad := np.concatenate(odd)):
            parts = np.split(ids[left], np.cumsum(counts)[:-1])
            for w in np.unique(np.searchsorted(ends, bad, side="right")).tolist():
                parts[w] = np.array(self.alone(words[w]), np.int64)
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids[left], counts

    def alone(self, word: bytes) -> list[int]:
        """Ids of one word, its lowest and then leftmost pair merged at a time: quadratic, for words that ``replay`` cannot order."""
        ids = [self.ranks[bytes([b])] for b in word]
        while True:
            made = [self.ranks.get(self.pieces[a] + self.pieces[b], len(self.pieces)) for a, b in zip(ids, ids[1:], strict=False)]
            best = min(made, default=len(self.pieces))
            if best == len(self.pieces):
                return ids
            at = made.index(best)
            ids[at : at + 2] = [best]

    def _learn(self, words: set[str]) -> list[str]:
        """Enter new words into the memo; those too long to stay there are returned."""
        whole = {w: r for w in words if (r := self.ranks.get(w.encode())) is not None}  # a word that is a piece is that piece
        fresh = [*whole, *sorted(words.difference(whole))]
        ids, counts = self.replay([w.encode() for w in fresh[len(whole) :]])
        ids, counts = np.concatenate([np.fromiter(whole.values(), np.int64, len(whole)), ids]), np.concatenate([np.ones(len(whole), np.int64), counts])
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(need, len(self.flat)), np.uint32)])
        self.flat[self.used : need] = ids
        if self.count + len(fresh) > len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros((max(len(fresh), len(self.spans)), 2), np.int64)])
        rows = self.spans[self.count : self.count + len(fresh)]
        rows[:, 0], rows[:, 1] = self.used + np.cumsum(counts) - counts, counts
        self.known.update(zip(fresh, range(self.count, self.count + len(fresh)), strict=True))
        self.used, self.count = need, self.count + len(fresh)
        return [w for w in fresh if len(w) > 64]

    def _block(self, held: list[tuple[int, list[str]]], out: list[list[np.ndarray]]) -> None:
        fresh: set[str] = set()
        for _, words in held:
            fresh.update(words)
        fresh.difference_update(self.known)
        long = self._learn(fresh) if fresh else []
        for i, words in held:
            starts, lengths = self.spans[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].T
            ends = np.cumsum(lengths)
            out[i].append(self.flat[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)])
        for w in long:
            del self.known[w]
        if self.count > self.limit or self.used > 32 * self.limit:
            self._start()

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text, as tiktoken's ``encode_ordinary`` gives them; null as empty."""
        out: list[list[np.ndarray]] = []
        held, size = [], 0
        for i, text in enumerate(texts):
            out.append([])
            for words in self.split.words(text or ""):
                held.append((i, words))
                size += sum(map(len, words))
                if size >= BLOCK:
                    self._block(held, out)
                    held, size = [], 0
        if held:
            self._block(held, out)
        return [np.concatenate(parts) if parts else np.zeros(0, np.uint32) for parts in out]

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of ids, in blocks; an unknown id has none."""
        pieces, n = self.pieces, len(self.pieces)
        for at in range(0, len(ids), STEP):
            yield b"".join([pieces[i] for i in ids[at : at + STEP].tolist() if 0 <= i < n])


_made: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per worker, file and pattern."""
    if (path, pattern) not in _made:
        _made[path, pattern] = Codec(read_ranks(path), pattern)
    return _made[path, pattern]


def id_list(found: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)))


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every whole text.

    Null and empty texts have no ids; special tokens are ordinary text.  Repeated
    rows are encoded each; a null doc_id stays null; other columns are not looked
    at; an empty table gives an empty one.  A worker holds one Arrow batch, the
    words of some 2**21 characters and the memo; one word without a border inside
    takes some 60 times its bytes.
    """
    path, pattern = ranks_path or default_path(), pattern or default_pattern()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            found = own.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), id_list(found)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and decoded (binary) of ``encoded(doc_id, ids)``; null ids give null, ids outside the vocabulary no bytes."""
    path, pattern = ranks_path or default_path(), pattern or default_pattern()
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = (batch.column("ids")[i] for i in range(batch.num_rows))
            out = [b"".join(own.decode(x.values.fill_null(-1).to_numpy(zero_copy_only=False))) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of each text's ids and of the bytes that these decode to.

    Edge cases are those of ``encode``.  Encoding and decoding run in one pass, so
    neither ids nor bytes leave the task.
    """
    path, pattern = ranks_path or default_path(), pattern or default_pattern()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, names, bodies = [], [], []
            for ids in own.encode(batch.column("text").to_pylist()):
                name, body = hashlib.sha256(), hashlib.sha256()
                for at in range(0, len(ids), STEP):
                    name.update((b" " if at else b"") + " ".join(map(str, ids[at : at + STEP].tolist())).encode())
                for part in own.decode(ids):
                    body.update(part)
                n.append(len(ids))
                names.append(name.hexdigest())
                bodies.append(body.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(bodies, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
