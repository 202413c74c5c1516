"""SimHash near-dedup by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, checkpoint, small_batches, unused
from .links import block_pairs, components, forest
from .tokenizer import release

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Per byte: whether it is white space.
IS_WHITE = np.isin(np.arange(256), list(WHITE))


def spaced(text: str | None) -> np.ndarray:
    """Bytes of the text's words, A-Z lower-cased, with one space between two words."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    white = IS_WHITE[raw]
    keep = ~white
    keep[1:] |= ~white[:-1]
    norm = np.where(white, np.uint8(32), raw)[keep]
    return norm[: len(norm) - 1] if len(norm) and norm[-1] == 32 else norm


def fingerprint(text: str | None, words: int = 3, block: int = 1 << 16) -> int:
    """Signed 64-bit fingerprint of the whole text's shingles, 0 if it has no word.

    ``block`` shingles are hashed at a time; beside the text and its places of
    spaces (8 bytes a word) no more is held, whatever the text's length.
    """
    norm = spaced(text)
    if not len(norm):
        return 0
    spaces = np.flatnonzero(norm == 32)
    n = max(1, len(spaces) + 2 - words)
    raw, ones, h = norm.tobytes(), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, block):
        # Shingle i runs from behind space i - 1 to space i + words - 1; the ends of the text stand for the missing ones.
        last = min(at + block, n)
        starts = (spaces[max(at - 1, 0) : last - 1] + 1).tolist()
        ends = spaces[at + words - 1 : last + words - 1].tolist()
        if at == 0:
            starts.insert(0, 0)
        if last == n:
            ends.append(len(norm))
        hashes = np.array([h(raw[s:e], 42) for s, e in zip(starts, ends, strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            prints = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, fp long")


def set_fingerprint(own: set[bytes], words: int = 8) -> bytes:
    """Fingerprint of ``words`` 64-bit words of distinct shingles; all zero if there is none."""
    ones, parts, h = np.zeros(64 * words, np.int64), list(own), xxhash.xxh64_digest
    for at in range(0, len(parts), 4096):
        raw = b"".join([h(s, seed) for s in parts[at : at + 4096] for seed in range(words)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(parts), bitorder="little").tobytes()


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values (one row of 64-bit words each), 64 values to a word."""
    count, words = values.shape
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(count, 8 * words), axis=1, bitorder="little").T
    padded = np.zeros((64 * words, -(-count // 64) * 64), np.uint8)
    padded[:, : len(values)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def near(queries: np.ndarray, values: np.ndarray, radius: int = 3, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, value) at ``radius`` or fewer differing bits.

    Fingerprints are numbers of 64 bits, or rows of several such words.  Values are compared 64 to a word, plane by plane.  A carry-save counter of a
    few bit planes holds all distances of a block of queries; counts above
    2**planes - 1 stay in an overflow plane.  A query whose values all exceed the
    radius is abandoned between planes.
    """
    width = (radius + 1).bit_length()
    queries, values = queries.reshape(len(queries), -1), values.reshape(len(values), -1)
    stored, found_q, found_v = planes(values), [], []
    lanes = np.zeros(stored.shape[1] * 64, np.uint8)
    lanes[: len(values)] = 1
    valid = np.packbits(lanes, bitorder="little").view(np.uint64)
    for at in range(0, len(queries), rows):
        live = np.arange(at, min(at + rows, len(queries)))
        own = queries[live]
        counter = np.zeros((width, len(live), stored.shape[1]), np.uint64)
        over = np.zeros((len(live), stored.shape[1]), np.uint64)
        for b in range(len(stored)):
            carry = stored[b][None, :] ^ np.where((own[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1), ALL, np.uint64(0))[:, None]
            for k in range(width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if b % 8 == 7 and radius <= b < len(stored) - 1:
                open_ = (~(over | exceeds(counter, radius)) & valid).any(axis=1)
                if not open_.all():
                    live, own, counter, over = live[open_], own[open_], counter[:, open_], over[open_]
                    if not len(live):
                        break
        if len(live):
            hits = ~(over | exceeds(counter, radius)) & valid
            q, v = np.nonzero(np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little"))
            found_q.append(live[q])
            found_v.append(v)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_v)


def exceeds(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``: a comparison with a constant, from the highest plane down."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ALL)
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above, equal = above | (equal & counter[k]), equal & ~counter[k]
    return above


def bands(blocks: int, shared: int) -> list[int]:
    """Masks of every choice of ``shared`` out of ``blocks`` even runs of bits.

    Two fingerprints that differ in up to blocks - shared bits agree on one.
    """
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(runs[i] for i in pick) for pick in combinations(range(blocks), shared)]


def links(prints: DataFrame, radius: int = 3, shared: tuple[int, ...] = (2, 4, 6), tile: int = 1024) -> DataFrame:
    """A spanning set of the links between distinct fingerprints, as a, b.

    Fingerprints meet where they agree on one of the choices of s of radius + s runs
    of bits, s the first of ``shared``, which every link does.  Those of a band with
    more than 4 x ``tile`` rows meet anew by the next s, whose bands have more bits
    and are smaller; the bands left aside have nothing but such fingerprints, so no
    link is lost.  Bands that stay hot to the last are compared tile by tile.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"], strict=True):
                a = np.asarray(a, np.int64)
                alone = b is None
                b = a if alone else np.asarray(b, np.int64)
                if alone and len(a) == 2:
                    if bin(int(a.view(np.uint64)[0] ^ a.view(np.uint64)[1])).count("1") <= radius:
                        yield pd.DataFrame({"a": [a.min()], "b": [a.max()]})
                    continue
                q, v = near(a.view(np.uint64), b.view(np.uint64), radius)
                if alone:
                    q, v = q[q < v], v[q < v]
                if len(q):
                    yield pd.DataFrame(forest(a[q], b[v]), columns=["a", "b"])

    pool, found = prints.select("fp"), None
    for s in shared:
        masks = [m - (1 << 64) if m >= 1 << 63 else m for m in bands(radius + s, s)]
        choices = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
        keyed = pool.select("fp", F.explode(choices).alias("key"))
        sizes = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("__n")).filter("__n > 1"))
        hot = sizes.filter(F.col("__n") > 4 * tile).select("key")
        split = s != shared[-1] and not hot.isEmpty()
        near_by = sizes.filter(F.col("__n") <= 4 * tile) if split else sizes
        own = block_pairs(keyed, "key", "fp", tile, "fp", near_by).select("a", "b").mapInPandas(compare, "a long, b long")
        found = own if found is None else found.unionByName(own)
        if not split:
            break
        pool = checkpoint(keyed.join(hot, "key", "semi").select("fp").distinct())
    return found.distinct()


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per document.

    component_id is the smallest doc_id reachable over links of ``radius`` or
    fewer differing bits.  Null, empty and blank texts have fingerprint zero and
    link like others.  Null doc_ids never are a component_id unless all of a
    component are null.  Repeated rows each have a row in the result; ties cannot
    arise, as a component's smallest id is one number; other columns are not looked
    at; an empty table gives an empty one.  Copies meet by their fingerprint before
    anything is compared.
    """
    prints = checkpoint(fingerprints(docs, words))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(checkpoint(links(distinct, radius)))
    led = distinct.join(found, distinct["fp"] == found["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    led = checkpoint(led.select("fp", "root", "first"))
    least = checkpoint(led.groupBy("root").agg(F.min("first").alias("component_id")))
    named = checkpoint(led.join(least, "root").select(F.col("fp").alias("own"), "component_id"))
    out = prints.join(named, prints["fp"] == named["own"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id.

    Rows that repeat a kept doc_id are one document and stay once.  Rows without
    a doc_id cannot be told from each other and all stay.  Columns are as in
    ``docs``, whatever they are called.
    """
    own = unused(docs.columns, "own_id")
    groups = checkpoint(near_groups(docs, words, radius))
    stay = groups.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    stay = checkpoint(stay)
    kept = docs.join(stay.select(F.col("doc_id").alias(own)), docs["doc_id"].eqNullSafe(F.col(own))).drop(own)
    if stay.filter(F.col("doc_id").isNotNull() & (F.col("n") > 1)).limit(1).count():
        alone, named = kept.filter("doc_id is null"), kept.filter("doc_id is not null").dropDuplicates(["doc_id"])
        kept = alone.unionByName(named)
    return kept.select(*docs.columns)
