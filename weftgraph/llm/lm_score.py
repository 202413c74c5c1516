"""Stupid-backoff language-model scores from n-gram count tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches, stored
from .tokenizer import default_path, release, tokenizer

#: Ids below 2**16, so n-grams up to order 3 are exact packed longs, the last token lowest.
BITS, START = 16, 49_406
BACKOFF = 0.4
SCALE = 1_000_000  # scores are summed as whole millionths, so that sums do not depend on order
HELD = 1_000_000  # n-grams or sums that a task holds before it hands them on
TIMES = 12  # bits of an entry that count; the rest is the text's place in its chunk
BLOCK = 6  # bits of a row inside its block
LOW = (1 << BLOCK) - 1


def packed(ids: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each token, with START before the text."""
    padded = np.concatenate([np.full(order - 1, START), ids]).astype(np.int64)
    out = np.zeros(len(ids), np.int64)
    for k in range(order):
        out = (out << BITS) | padded[k : k + len(ids)]
    return out


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each one's values, in whole numbers."""
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(own), np.int64)
    np.add.at(out, at, np.concatenate(values))
    return own, out


def token_ids(docs: DataFrame, path: str, learn: Column | None = None) -> DataFrame:
    """row (unique), doc_id, learned (whether the model counts it: ``learn``, null as true) and ids, the text's token ids as little-endian unsigned 16-bit numbers: each text is tokenized once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokenizer(path)
        for batch in batches:
            ids = [made.ids(t).astype("<u2").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("learned"), pa.array(ids, pa.binary())], ["row", "doc_id", "learned", "ids"])

    learned = F.lit(True) if learn is None else F.coalesce(learn, F.lit(True))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), learned.alias("learned"), "text")
    return rows.mapInArrow(make, "row long, doc_id long, learned boolean, ids binary")


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2")


def gram_counts(tokens: DataFrame, order: int) -> DataFrame:
    """gram and n over all documents, partitioned by hash; each task sums what it has read before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        keys, values, size = [], [], 0

        def frame() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in summed(keys, values)], ["gram", "n"])

        for batch in batches:
            own, n = np.unique(np.concatenate([packed(unpacked(t), order) for t in batch.column("ids").to_pylist()]), return_counts=True)
            keys.append(own)
            values.append(n)
            size += len(own)
            if size > HELD:
                merged = summed(keys, values)
                keys, values, size = [merged[0]], [merged[1]], len(merged[0])
                if size > HELD // 2:
                    yield frame()
                    keys, values, size = [], [], 0
        if keys:
            yield frame()

    return tokens.select("ids").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def score_tables(counts: DataFrame, order: int, least: int) -> list[DataFrame]:
    """For k = 1..order: gram and score (millionths of ln(count / context count)).

    Above k = 1, n-grams with a count under ``least`` are left to backoff.
    Lower orders are sums of the highest.
    """
    tables, of_k = [], counts
    for k in range(order, 0, -1):
        if k < order:
            of_k = of_k.groupBy(F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        context = F.shiftright("gram", BITS) if k > 1 else F.lit(0).cast("long")
        of_k = checkpoint(of_k)
        whole = of_k.groupBy(context.alias("context")).agg(F.sum("n").alias("all"))
        kept = of_k.filter(F.col("n") >= (least if k > 1 else 1)).withColumn("context", context)
        if k == 1:
            total = whole.first()
            scored = kept.withColumn("all", F.lit(total["all"] if total else 1))
        else:
            whole = checkpoint(whole)
            scored = kept.join(F.broadcast(whole) if k == 2 else whole, "context")  # at most 2**16 contexts of one token
        tables.append(scored.select("gram", F.round(F.log(F.col("n") / F.col("all")) * SCALE).cast("long").alias("score")))
    return tables[::-1]


def score_grams(counts: DataFrame, learned: DataFrame, order: int, least: int) -> DataFrame:
    """gram, n and score of every n-gram of ``counts``, by the model of ``learned``; backed off by joins to the tables of lower orders.

    A token that the model has never seen counts as seen once.  Where both are
    one table and ``least`` is 1 none backs off, as all are counted.
    """
    if learned is counts and least <= 1:
        context = F.shiftright("gram", BITS) if order > 1 else F.lit(0).cast("long")
        known = counts.withColumn("context", context)
        whole = checkpoint(known.groupBy("context").agg(F.sum("n").alias("all")))
        scored = known.join(F.broadcast(whole) if order <= 2 else whole, "context")
        return scored.select("gram", "n", F.round(F.log(F.col("n") / F.col("all")) * SCALE).cast("long").alias("score"))
    tables = score_tables(learned, order, least)
    penalty = round(math.log(BACKOFF) * SCALE)
    scored, score = counts, None
    for k in range(order, 0, -1):
        table = tables[k - 1].toDF(f"g{k}", f"s{k}")
        table = F.broadcast(table) if k == 1 else table  # at most 2**16 rows
        scored = scored.join(table, F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)) == F.col(f"g{k}"), "left")
        own = F.col(f"s{k}") + penalty * (order - k)
        score = own if score is None else F.coalesce(score, own)
    total = learned.agg(F.sum("n")).first()[0] or 1
    unseen = round(math.log(1 / total) * SCALE) + penalty * (order - 1)
    return scored.select("gram", "n", F.coalesce(score, F.lit(unseen)).cast("long").alias("score"))


def binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """``values``, cut at ``starts``, as binaries without a copy for each."""
    ends = np.append(starts, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def unpack(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binaries, and the row that each comes from."""
    values = np.frombuffer(b"".join(column.to_pylist()), kind)
    sizes = pc.binary_length(column).to_numpy() // np.dtype(kind).itemsize
    return np.repeat(np.arange(len(column)), sizes), values


def explode_grams(tokens: DataFrame, order: int, hot: pd.DataFrame) -> DataFrame:
    """gram, base and entries: the texts that hold an n-gram, gathered over a chunk of some texts.

    An entry is 32 bits: the text's row less ``base``, and how often it has the
    n-gram (more often than fits gives more entries).  The ``hot`` n-grams are
    summed here: those sums are (row, sum) pairs under a gram below 0, which no
    n-gram has.
    """
    hot = hot.sort_values("gram")
    shared = tokens.sparkSession.sparkContext.broadcast((hot["gram"].to_numpy(np.int64), hot["score"].to_numpy(np.int64)))
    most, names = (1 << TIMES) - 1, ["gram", "base", "entries"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        keys, scores = shared.value
        base, size, grams_in, entries_in, sums = None, 0, [], [], []

        def frames() -> Iterator[pa.RecordBatch]:
            grams, entries = np.concatenate(grams_in), np.concatenate(entries_in)
            order_ = np.argsort(grams, kind="stable")
            grams, entries = grams[order_], entries[order_]
            starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(grams[starts]), pa.array(np.full(len(starts), base)), binaries(entries, starts)], names)
            pairs = np.array(sums, np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([-1 - base]), pa.array([base]), pa.array([pairs.tobytes()], pa.binary())], names)

        for batch in batches:
            for row, ids in zip(batch.column("row").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if base is not None and (size >= HELD or not 0 <= row - base < 1 << 32 - TIMES):
                    yield from frames()
                    base, size, grams_in, entries_in, sums = None, 0, [], [], []
                base = row if base is None else base
                grams, times = np.unique(packed(unpacked(ids), order), return_counts=True)
                total = 0
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    hit = keys[at] == grams
                    total = int((scores[at[hit]] * times[hit]).sum())
                    grams, times = grams[~hit], times[~hit]
                if len(times) and times.max() > most:
                    parts = -(-times // most)
                    ends = np.cumsum(parts)
                    last = times - (parts - 1) * most
                    grams, times = np.repeat(grams, parts), np.full(ends[-1], most)
                    times[ends - 1] = last
                grams_in.append(grams)
                entries_in.append((np.uint32(row - base) << np.uint32(TIMES)) | times.astype(np.uint32))
                sums.append((row, total))
                size += len(grams)
        if base is not None:
            yield from frames()

    return tokens.select("row", "ids").mapInArrow(explode, "gram long, base long, entries binary")


def sum_scores(joined: DataFrame) -> DataFrame:
    """row and total, from base, entries and score; a null score marks pairs of row and sum.

    A task's sums leave it as one binary for each block of 64 rows, a number for
    each row: its sum, with its place in the block as the lowest bits.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rows, sums, size = [], [], 0

        def frame() -> pa.RecordBatch:
            own, totals = summed(rows, sums)
            starts = np.flatnonzero(np.diff(own >> BLOCK, prepend=own[0] - (1 << BLOCK)))
            return pa.RecordBatch.from_arrays([pa.array(own[starts] >> BLOCK), binaries(totals << BLOCK | own & LOW, starts)], ["block", "sums"])

        for batch in batches:
            ready = batch.column("score").is_null()
            known = batch.filter(pc.invert(ready))
            pairs = batch.filter(ready).column("entries").to_pylist()
            if known.num_rows:
                at, entries = unpack(known.column("entries"), np.uint32)
                rows.append(known.column("base").to_numpy()[at] + (entries >> np.uint32(TIMES)).astype(np.int64))
                sums.append(known.column("score").to_numpy()[at] * (entries & np.uint32((1 << TIMES) - 1)).astype(np.int64))
                size += len(entries)
            if pairs:
                both = np.frombuffer(b"".join(pairs), np.int64).reshape(-1, 2)
                rows.append(both[:, 0])
                sums.append(both[:, 1])
                size += len(both)
            if size > HELD:
                merged = summed(rows, sums)
                rows, sums, size = [merged[0]], [merged[1]], len(merged[0])
                if size > HELD // 2:
                    yield frame()
                    rows, sums, size = [], [], 0
        if size:
            yield frame()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            at, both = unpack(batch.column("sums"), np.int64)
            blocks = batch.column("block").to_numpy()
            rows, sums = summed([rows, blocks[at] << BLOCK | both & LOW], [sums, both >> BLOCK])
            done = rows >> BLOCK < blocks[-1]
            yield pa.RecordBatch.from_arrays([pa.array(rows[done]), pa.array(sums[done])], ["row", "total"])
            rows, sums = rows[~done], sums[~done]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(sums)], ["row", "total"])

    blocks = joined.select("base", "entries", "score").mapInArrow(spread, "block long, sums binary")
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "row long, total long")


def score_documents(docs: DataFrame, order: int = 2, least: int = 1, tokenizer_path: str | None = None, hot_share: int = 4096, learn: Column | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_score (sum of natural logs) and mean_score.

    The model is counted over the documents for which ``learn``, a condition on
    their columns, is true or null, by default over all: S(w | context) is
    count / context count where the n-gram was seen ``least`` times or more, else
    0.4 times the score one order lower; unigrams always count, a token that the
    model has not seen as if seen once.  All documents are scored.  Null and empty
    texts have no tokens, a log_score of 0 and a null mean_score.  Repeated rows
    are scored alike, each in a row of its own; a null doc_id stays null; an empty
    table gives an empty one; other columns are not looked at.

    The texts' n-grams are exploded, those of a chunk of texts gathered by n-gram,
    joined by hash to the table of scores and summed per text.  N-grams that make
    up more than one in ``hot_share`` of all, so fewer than ``hot_share`` of them,
    would crowd their partitions: their scores are sent to the tasks that explode.
    0 sends none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokens = stored(token_ids(docs, tokenizer_path or default_path(), learn))
    counts = stored(gram_counts(tokens, order))
    learned = counts if learn is None else stored(gram_counts(tokens.filter("learned"), order))
    model = stored(score_grams(counts, learned, order, least))
    everything = counts.agg(F.sum("n")).first()[0] or 0
    hot = model.filter(F.col("n") * hot_share > everything).select("gram", "score").toPandas()
    known = model.select(F.col("gram").alias("known"), "score")
    grams = explode_grams(tokens, order, hot).join(known, F.col("gram") == F.col("known"), "left")
    small_batches(spark, rows=10_000)
    sums = stored(sum_scores(grams))
    lengths = tokens.select("row", "doc_id", F.expr("cast(length(ids) div 2 AS long)").alias("n_tokens"))
    log_score = F.col("total") / F.lit(float(SCALE))
    return lengths.join(sums, "row").select(
        "doc_id", "n_tokens", log_score.alias("log_score"), F.when(F.col("n_tokens") > 0, log_score / F.col("n_tokens")).alias("mean_score")
    )
