"""Power-of-two decomposition: each document is cut into pieces of binary length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, number_rows, small_batches
from .tokenizer import default_path, tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def binary_lengths(total: int, longest: int) -> list[int]:
    """Piece lengths, longest first: as many ``longest`` as fit, then the binary digits of the rest."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, longest: int = 4096, end_id: int = 2, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document's ids, closed by ``end_id``.

    A piece never crosses documents.  Null and empty texts have the one id
    ``end_id``.  Repeated rows are cut alike, each into pieces of its own; a null
    doc_id stays null; other columns are not looked at; an empty table gives an
    empty one.  ``with_ids`` adds the ids.
    """
    path = tokenizer_path or default_path()
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokenizer(path)
        for batch in batches:
            rows, every = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(made.ids(text), np.uint32(end_id)).astype("<u4")
                start = 0
                for n in binary_lengths(len(ids), longest):
                    rows.append((at, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)))
                    start += n
                every.append(ids)
            if rows:
                at, *numbers = np.array(rows, np.int64).T
                arrays = [batch.column("doc_id").take(pa.array(at)), *map(pa.array, numbers)]
                if with_ids:  # pieces follow each other as their ids do
                    ends = np.concatenate([[0], np.cumsum(numbers[1])])
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(every).view("<i4"))))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, longest: int = 4096, end_id: int = 2, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence.

    Each piece is a sequence of its own, so every sequence has a power-of-two
    length and none is padded.  Sequences are numbered gapless from 0, equal
    lengths next to each other and the longest first: ``bucket`` is log2 of the
    length, and any run of ids inside a bucket is a batch without padding.  The
    same piece of the same document gets the same number in a rerun, but for rows
    that agree in doc_id and ids, which are interchangeable.  Nulls, repeated rows
    and empty tables: see ``pieces``.  ``with_ids``
    adds the ids: pieces are numbered without them, and they are joined behind.
    """
    cut = pieces(docs, longest, end_id, tokenizer_path, with_ids)
    if with_ids:
        cut = cut.withColumn("__piece", F.monotonically_increasing_id())
    cut = checkpoint(cut)
    bucketed = cut.drop("ids").withColumn("bucket", (F.length(F.bin("length")) - 1).cast("int"))
    ranked = number_rows(bucketed, ["bucket"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "__rank")
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    # At most log2(longest) + 1 rows: what lies before each bucket.
    before = (
        sizes.groupBy()
        .agg(F.collect_list(F.struct("bucket", "n")).alias("all"))
        .select("all", F.explode("all").alias("own"))
        .select(
            F.col("own.bucket").alias("bucket"),
            F.aggregate(F.filter("all", lambda x: x["bucket"] > F.col("own.bucket")), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("__before"),
        )
    )
    out = ranked.join(F.broadcast(before), "bucket")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    numbered = out.select(
        *names,
        (F.col("__before") + F.col("__rank")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        "bucket",
        *(["__piece"] if with_ids else []),
    )
    if not with_ids:
        return numbered
    # The slim side is hashed, so that the ids are shuffled but not sorted.
    return cut.select("__piece", "ids").join(numbered.hint("shuffle_hash"), "__piece").select(*[c for c in numbered.columns if c != "__piece"], "ids")
