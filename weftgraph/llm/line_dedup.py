"""Line dedup with two Bloom filters: once seen and twice seen."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, checkpoint, next_power_of_two, small_batches, unused, widened
from .tokenizer import release

HASHES = 4
PIECE = 1 << 16  # bytes of a filter that travel together


def line_keys(text: str | None, least: int = 1) -> tuple[list[bytes], list[bytes | None]]:
    """The text's lines, and of each its key: ASCII white space stripped, A-Z lowered; None if under ``least`` code points."""
    lines = (text or "").encode("utf-8", "replace").split(b"\n")
    keys = [line.strip(WHITE).lower() for line in lines]
    return lines, [k if len(k) >= least and (least <= 1 or len(k.decode()) >= least) else None for k in keys]


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``HASHES`` bit positions of each 64-bit hash, by double hashing; ``bits`` is a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


class Seen:
    """The two filters as packed bits."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    @staticmethod
    def _test(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    @staticmethod
    def _set(filter_: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(filter_, (at >> np.uint64(3)).ravel(), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8).ravel())

    def add(self, hashes: np.ndarray) -> None:
        """Hashes that come twice here or came before go to twice."""
        own, counts = np.unique(hashes, return_counts=True)
        at = positions(own, self.bits)
        self._set(self.twice, at[(counts > 1) | self._test(self.once, at)])
        self._set(self.once, at)

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        return self._test(self.twice, positions(hashes, self.bits))


def hashes_of(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


def build_filter(docs: DataFrame, bits: int, least: int = 1, builders: int = 2048) -> np.ndarray:
    """The twice-seen filter over every document's distinct keys.

    At most ``builders`` tasks fill a pair of filters each; pieces of the pairs
    are merged by position: what is in two once filters, or in a twice filter,
    is in twice.  A key of two documents is always found; others may be.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        seen = Seen(bits)
        for batch in batches:
            keys = [k for text in batch["text"] for k in {*line_keys(text, least)[1]} - {None}]
            if keys:
                seen.add(hashes_of(keys))
        for at in range(0, bits // 8, PIECE):
            once = seen.once[at : at + PIECE]
            if once.any():
                yield pd.DataFrame({"piece": [at // PIECE], "once": [once.tobytes()], "twice": [seen.twice[at : at + PIECE].tobytes()]})

    def merge(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once = twice = None
        for frame in frames:
            for a, b in zip(frame["once"], frame["twice"], strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                once, twice = (a.copy(), b.copy()) if once is None else (once | a, twice | b | (once & a))
        yield pd.DataFrame({"piece": [key[0]], "twice": [twice.tobytes()]})

    texts = docs.select("text")
    parts = texts.rdd.getNumPartitions()
    filled = (texts.coalesce(builders) if parts > builders else texts).mapInPandas(fill, "piece int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for piece, twice in filled.groupBy("piece").applyInPandas(merge, "piece int, twice binary").collect():
        out[piece * PIECE : piece * PIECE + len(twice)] = np.frombuffer(twice, np.uint8)
    return out


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def repeated_keys(docs: DataFrame, twice: np.ndarray, documents: int, least: int = 1) -> DataFrame:
    """Keys in at least ``documents`` documents: digest, n_docs, first_doc and first_line.

    Only keys that the filter suspects are shuffled, summed per batch before;
    they are grouped by the key itself, so the count is exact.  first_doc is the
    smallest doc_id that has the key (null last) and first_line its first line there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(twice)
    bits = len(twice) * 8

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen = Seen(8)
        seen.bits, seen.twice = bits, shared.value
        for batch in batches:
            found: dict[bytes, list] = {}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                first: dict[bytes, int] = {}
                for i, k in enumerate(line_keys(text, least)[1]):
                    if k is not None:
                        first.setdefault(k, i)
                if not first:
                    continue
                keys = list(first)
                order = (1, 0) if doc_id is None else (0, doc_id)
                for k, hit in zip(keys, seen.repeated(hashes_of(keys)), strict=True):
                    if hit:
                        mine = found.setdefault(k, [0, (*order, first[k])])
                        mine[0] += 1
                        mine[1] = min(mine[1], (*order, first[k]))
            if found:
                firsts = np.array([v[1] for v in found.values()], np.int64)
                arrays = [
                    pa.array(list(found), pa.binary()),
                    pa.array([digest(k) for k in found], pa.binary()),
                    pa.array([v[0] for v in found.values()], pa.int64()),
                    pa.array(firsts[:, 0].astype(np.int32)),
                    pa.array(firsts[:, 1]),
                    pa.array(firsts[:, 2]),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "digest", "n", "no_id", "first_doc", "first_line"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = slim.mapInArrow(suspected, "key binary, digest binary, n long, no_id int, first_doc long, first_line long")
    exact = rows.groupBy("key", "digest").agg(F.sum("n").alias("n_docs"), F.min(F.struct("no_id", "first_doc", "first_line")).alias("first"))
    return exact.filter(F.col("n_docs") >= documents).select(
        "digest",
        "n_docs",
        F.when(F.col("first.no_id") == 0, F.col("first.first_doc")).alias("first_doc"),
        F.col("first.first_line").alias("first_line"),
    )


class Table:
    """Digests with their first place, sorted for lookup; 16 + 16 bytes an entry."""

    def __init__(self, digests: list[bytes], docs: list[int | None], lines: list[int]):
        both = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)
        order = np.lexsort((both[:, 1], both[:, 0]))
        self.high, self.low = both[order, 0].astype(np.uint64), both[order, 1].astype(np.uint64)
        self.docs = np.array([-1 if d is None else d for d in docs], np.int64)[order]
        self.none = np.array([d is None for d in docs], bool)[order]
        self.lines = np.array(lines, np.int64)[order]

    def find(self, digests: list[bytes]) -> np.ndarray:
        """Index of each digest, -1 where absent."""
        want = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
        at = np.searchsorted(self.high, want[:, 0])
        out = np.full(len(want), -1)
        open_ = at < len(self.high)
        while open_.any():
            same = open_ & (self.high[np.minimum(at, len(self.high) - 1)] == want[:, 0])
            hit = same & (self.low[np.minimum(at, len(self.high) - 1)] == want[:, 1])
            out[hit] = at[hit]
            at = at + 1
            open_ = same & ~hit & (at < len(self.high))
        return out


def strip_lines(doc_id, text: str | None, table: Table | None, keep_first: bool, least: int) -> tuple[str, int, int]:
    """What is left of a text, its number of lines, and how many were dropped."""
    lines, keys = line_keys(text, least)
    if table is None or not len(table.high):
        return "\n".join(x.decode("utf-8", "replace") for x in lines), len(lines), 0
    at = table.find([digest(k if k is not None else b"") for k in keys])
    drop = (at >= 0) & np.array([k is not None for k in keys])
    if keep_first:
        missing = doc_id is None
        for i in np.flatnonzero(drop):
            j = at[i]
            if table.lines[j] == i and bool(table.none[j]) == missing and (missing or table.docs[j] == doc_id):
                drop[i] = False
    if not drop.any():
        return text or "", len(lines), 0
    return b"\n".join(x for x, d in zip(lines, drop, strict=True) if not d).decode("utf-8", "replace"), len(lines), int(drop.sum())


def stripper(keep_first: bool, least: int, counts: bool):
    """A function from a batch and its texts' tables to the batch with text replaced, and with ``counts`` the two counts behind."""

    def strip(batch: pa.RecordBatch, tables: list[Table | None]) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        out = [strip_lines(d, t, own, keep_first, least) for d, t, own in zip(batch.column("doc_id").to_pylist(), texts, tables, strict=True)]
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, batch.schema.field(at), pa.array([o[0] for o in out], batch.schema.field(at).type))
        if not counts:
            return batch
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], [*batch.schema.names, "n_lines", "n_dropped"])

    return strip


def dedup_lines(
    docs: DataFrame,
    documents: int = 10,
    least: int = 1,
    keep_first: bool = False,
    bits: int | None = None,
    broadcast_limit: int = 1_000_000,
    counts: bool = True,
) -> DataFrame:
    """``docs`` with repeated lines gone from text, and with ``counts`` n_lines and n_dropped.

    A key of at least ``least`` code points that is in ``documents`` or more
    documents (rows, so repeated rows count each) loses all of its lines; with
    ``keep_first`` the first line of the smallest doc_id that has it stays (null
    ids are last; of rows that share that doc_id each keeps it).  Null and empty
    texts are one empty line; a null text comes back empty.  Other columns pass
    through untouched; only with ``counts`` are columns of the two output names
    replaced.  An empty table gives an empty one.

    The filter has ``bits`` bits: 64 a document by default, 2**20 to 2**28 (32
    MB).  Beyond some 50 million distinct lines it marks ever more single lines
    as suspects; these are shuffled and counted exactly, so results hold at any
    size.  Up to ``broadcast_limit`` repeated keys (32 bytes each) are sent to all
    tasks; beyond it the texts' suspected lines join them by shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if bits is None:
        bits = min(1 << 28, max(1 << 20, next_power_of_two(64 * docs.count())))
    twice = build_filter(docs, bits, least)
    found = checkpoint(repeated_keys(docs, twice, documents, least))
    kept = docs.drop("n_lines", "n_dropped") if counts else docs
    schema = widened(kept.schema, n_lines="long", n_dropped="long") if counts else kept.schema
    strip = stripper(keep_first, least, counts)
    if found.count() <= broadcast_limit:
        rows = found.collect()
        shared = spark.sparkContext.broadcast(Table([bytes(r[0]) for r in rows], [r[2] for r in rows], [r[3] for r in rows]))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                yield strip(batch, [shared.value] * batch.num_rows)

        return kept.mapInArrow(apply, schema)
    return _dedup_by_join(kept, schema, twice, found, strip, least)


def _dedup_by_join(docs: DataFrame, schema, twice: np.ndarray, found: DataFrame, strip, least: int) -> DataFrame:
    """The way beyond the broadcast limit: each text's suspected keys, joined by digest, come back as one array per text."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)
    bits = len(twice) * 8

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen = Seen(8)
        seen.bits, seen.twice = bits, shared.value
        for batch in batches:
            rows = []
            for own, text in zip(batch.column("own").to_pylist(), batch.column("text").to_pylist(), strict=True):
                keys = list({*line_keys(text, least)[1]} - {None})
                if keys:
                    rows += [(own, digest(k)) for k, hit in zip(keys, seen.repeated(hashes_of(keys)), strict=True) if hit]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["own", "digest"])

    text_hash = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    wanted = docs.select(text_hash.alias("own"), "text").mapInArrow(suspected, "own string, digest binary").distinct()
    by_text, keys_name = unused(docs.columns, "own"), unused(docs.columns, "keys")
    per_text = wanted.join(found, "digest").groupBy(F.col("own").alias(by_text)).agg(F.collect_list(F.struct("digest", "first_doc", "first_line")).alias(keys_name))
    joined = docs.join(per_text, text_hash == F.col(by_text), "left").select(*[docs[c] for c in docs.columns], keys_name)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            tables = [Table([k["digest"] for k in keys], [k["first_doc"] for k in keys], [k["first_line"] for k in keys]) if keys else None for keys in batch.column(keys_name).to_pylist()]
            yield strip(batch.drop_columns([keys_name]), tables)

    return joined.mapInArrow(apply, schema)


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is left of each text."""
    out = dedup_lines(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], documents: int = 10) -> list[tuple]:
    """The contract on a small fixture, for tests."""
    from collections import Counter

    counts: Counter = Counter()
    for _, text in rows:
        counts.update({*line_keys(text)[1]} - {None})
    out = []
    for doc_id, text in rows:
        lines, keys = line_keys(text)
        left = [x for x, k in zip(lines, keys, strict=True) if k is None or counts[k] < documents]
        out.append((doc_id, len(lines), len(lines) - len(left), hashlib.sha256(b"\n".join(left)).hexdigest()))
    return out
