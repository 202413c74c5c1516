"""Exact dedup by a Golomb-coded fingerprint exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, next_power_of_two, small_batches, text_of, widened

CHUNK_BITS = 17  # a sender's message covers at most 2**17 rows


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned 64-bit values as Golomb-Rice coded gaps.

    Head: count (4 bytes), first value (8), remainder width (1).  Body: the
    quotients in unary, then the remainders at that width.
    """
    values = values.astype(np.uint64)
    head = np.uint32(len(values)).tobytes()
    if not len(values):
        return head
    gaps = np.diff(values)
    mean = int(values[-1] - values[0]) // max(1, len(gaps))
    width = max(0, mean.bit_length() - 1)
    head += values[0].tobytes() + bytes([width])
    quotients = (gaps >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(len(gaps), np.int64)
    unary = np.ones(int(quotients.sum()) + len(quotients), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return head + np.packbits(np.concatenate([unary, rest])).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    if n == 0:
        return np.zeros(0, np.uint64)
    first, width = np.frombuffer(data, np.uint64, 1, 4)[0], data[12]
    if n == 1:
        return np.array([first], np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=13))
    ends = np.flatnonzero(bits == 0)[: n - 1]
    quotients = np.diff(np.concatenate([[-1], ends])) - 1
    rest = bits[ends[-1] + 1 : ends[-1] + 1 + (n - 1) * width].reshape(n - 1, width)
    gaps = quotients.astype(np.uint64) << np.uint64(width)
    for i in range(width):
        gaps |= rest[:, i].astype(np.uint64) << np.uint64(width - 1 - i)
    return np.concatenate([[first], first + np.cumsum(gaps, dtype=np.uint64)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row (unique), message (sender's chunk of rows), h (64-bit hash), digest and length of the text's bytes."""
    body = text_of().cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS).alias("message"),
        F.xxhash64(text_of()).alias("h"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.octet_length(body).cast("long").alias("n_bytes"),
    )


def suspects(prints: DataFrame, owner_bits: int) -> DataFrame:
    """``prints`` with suspect: whether another row may have the same hash.

    Each message sends its sorted distinct hashes, Golomb coded, to the owners of
    their top ``owner_bits`` bits.  An owner answers every message with a bitmap
    over its hashes: 1 where another message has the hash too.  Repeats inside a
    message are known to it already.
    """
    shift = np.uint64(64 - owner_bits)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        current = None

        def flush() -> pd.DataFrame:
            own = np.unique(np.concatenate(held))
            owners = (own >> shift).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
            parts = np.split(own, starts[1:])
            return pd.DataFrame({"message": current, "owner": owners[starts], "payload": [golomb_encode(p) for p in parts]})

        for batch in batches:
            for message, rows in batch.groupby("message", sort=True):
                if current is not None and message != current:
                    yield flush()
                    held = []
                current = message
                held.append(rows["h"].to_numpy(np.int64).view(np.uint64))
        if held:
            yield flush()

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        got = [golomb_decode(p) for p in frame["payload"]]
        values, counts = np.unique(np.concatenate(got), return_counts=True)
        twice = values[counts > 1]
        bitmaps = [np.packbits(np.isin(g, twice, assume_unique=True)).tobytes() for g in got]
        return pd.DataFrame({"message": frame["message"], "owner": frame["owner"], "bitmap": bitmaps})

    def mark(rows: pa.Table, answers: pa.Table) -> pa.Table:
        hashes = rows.column("h").to_numpy().astype(np.int64).view(np.uint64)
        own, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        flags = counts > 1
        owners = (own >> shift).astype(np.int64)
        for owner, bitmap in zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist(), strict=True):
            lo, hi = np.searchsorted(owners, [owner, owner + 1])
            flags[lo:hi] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=hi - lo).astype(bool)
        return rows.append_column("suspect", pa.array(flags[at]))

    messages = prints.select("message", "h").mapInPandas(send, "message long, owner long, payload binary")
    answers = messages.groupBy("owner").applyInPandas(answer, "message long, owner long, bitmap binary")
    return prints.groupBy("message").cogroup(answers.groupBy("message")).applyInArrow(mark, widened(prints.schema, suspect="boolean"))


def exact_groups(docs: DataFrame, rows_per_owner: int = 250_000) -> DataFrame:
    """One row per document with the copy that stays.

    Equal means identical bytes; null counts as empty.  Of equal texts the row
    with the largest doc_id stays (null ids are smallest; of rows that repeat an
    id, one: ties are broken by place in the table).  A group whose ids are all null
    has a null keep_id.  Other columns are not looked at; an empty table gives an
    empty one.  Suspects alone are shuffled by content; the SHA-256 and length of
    all their bytes, taken in the one scan, stand for the bytes there, so text
    itself is never moved.  Owners hold about ``rows_per_owner`` hashes each.
    """
    small_batches(docs.sparkSession, rows=20_000)
    prints = checkpoint(fingerprints(docs))
    owner_bits = max(5, next_power_of_two(prints.count() // rows_per_owner).bit_length() - 1)
    marked = checkpoint(suspects(prints, owner_bits))
    groups = checkpoint(
        marked.filter("suspect")
        .groupBy("digest", "n_bytes")
        .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("keep"))
        .filter("n > 1")
    )
    loose = marked.filter("not suspect").withColumns({"n": F.lit(None).cast("long"), "keep": F.lit(None).cast("struct<doc_id:bigint,row:bigint>")})
    tied = marked.filter("suspect").join(groups, ["digest", "n_bytes"], "left")
    return tied.unionByName(loose).select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep.row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
