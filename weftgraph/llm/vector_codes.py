"""Product codes of vectors by integer k-means, with exact nearest entries from kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Components of this size or more are refused: squared distances of longs would no longer be safe.
TOO_LARGE = 1 << 16


@dataclass(frozen=True)
class Node:
    """A box of a kd-tree around its entries: a split of two nodes, or a leaf's entries with their indexes."""

    low: np.ndarray
    high: np.ndarray
    axis: int = -1
    at: int = 0
    below: Node | None = None
    above: Node | None = None
    entries: np.ndarray | None = None
    index: np.ndarray | None = None


def kd_tree(entries: np.ndarray, index: np.ndarray | None = None, leaf: int = 8) -> Node:
    """A kd-tree over the rows of ``entries``, split at the median of the widest axis; rows that are all equal stay one leaf."""
    index = np.arange(len(entries)) if index is None else index
    low, high = entries.min(axis=0, initial=np.iinfo(np.int64).max), entries.max(axis=0, initial=np.iinfo(np.int64).min)
    width = high - low
    if len(entries) <= leaf or not width.any():
        return Node(low, high, entries=entries, index=index)
    axis = int(width.argmax())
    own = entries[:, axis]
    at = int(np.sort(own)[len(own) // 2])
    if at == own.min():
        at = int(own[own > at].min())
    below = own < at
    return Node(low, high, axis, at, kd_tree(entries[below], index[below], leaf), kd_tree(entries[~below], index[~below], leaf))


def _try_leaf(node: Node, x: np.ndarray, rows: np.ndarray, best: np.ndarray, which: np.ndarray) -> None:
    gaps = x[rows, None, :] - node.entries[None, :, :]
    far = np.einsum("ijk,ijk->ij", gaps, gaps)
    least = far.min(axis=1)
    entry = np.where(far == least[:, None], node.index[None, :], np.iinfo(np.int64).max).min(axis=1)
    better = (least < best[rows]) | (least == best[rows]) & (entry < which[rows])
    best[rows[better]], which[rows[better]] = least[better], entry[better]


def nearest(tree: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, and its squared distance; of equally near ones the lowest index.

    Each row first goes down to the leaf on its side of every split, which bounds
    its distance.  Then the tree is walked once for all rows: a node is entered by
    the rows whose distance to its box is not above their bound.  Rows at just
    their bound go in too, so an equally near entry of lower index is found.
    """
    best, which = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)
    own: dict[int, np.ndarray] = {}
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node.entries is not None:
            own[id(node)] = rows
            _try_leaf(node, x, rows, best, which)
            continue
        side = x[rows, node.axis] < node.at
        todo += [(node.below, rows[side]), (node.above, rows[~side])]
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        gaps = np.maximum(np.maximum(node.low - x[rows], x[rows] - node.high), 0)
        rows = rows[np.einsum("ij,ij->i", gaps, gaps) <= best[rows]]
        if not len(rows):
            continue
        if node.entries is None:
            todo += [(node.below, rows), (node.above, rows)]
        elif len(rows := np.setdiff1d(rows, own.get(id(node), rows[:0]), assume_unique=True)):
            _try_leaf(node, x, rows, best, which)
    return which, best


def matrix(vectors: pa.Array, length: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), length)


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and v (array of int): floor(1024 * x) of every component, without vectors that are null or hold a null or non-finite component."""
    x = F.col("embedding").cast("array<double>")
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    large = F.exists(x, lambda c: F.abs(c) >= TOO_LARGE)
    refused = F.raise_error(F.concat(F.lit(f"vector with a component of {TOO_LARGE} or more, vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    whole = F.transform(x, lambda c: F.floor(c * 1024).cast("int"))
    return embeddings.filter(F.col("embedding").isNotNull() & F.forall(x, sound)).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.when(large, refused.cast("array<int>")).otherwise(whole).alias("v"))


def _assigned(whole: np.ndarray, trees: list[Node]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per part: the part's components, nearest entries and squared distances."""
    width = whole.shape[1] // len(trees)
    for p, tree in enumerate(trees):
        x = np.ascontiguousarray(whole[:, p * width : (p + 1) * width])
        yield x, *nearest(tree, x)


def train(rows: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component) after ``rounds`` of assigning all ``rows(v)`` and averaging, all in integers.

    The trees go out by broadcast, which is as large as the codebooks; sums come
    back as one row per part and entry from each task, added up by a shuffle.
    """
    spark = rows.sparkSession
    parts, _, width = books.shape
    columns = [f"s{i}" for i in range(width)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast([kd_tree(b) for b in books])

        def sums(batches: Iterator[pa.RecordBatch], shared=shared, shape=books.shape) -> Iterator[pa.RecordBatch]:
            trees = shared.value
            n, total = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
            for batch in batches:
                for p, (x, entry, _) in enumerate(_assigned(matrix(batch.column("v"), shape[0] * shape[2]), trees)):
                    n[p] += np.bincount(entry, minlength=shape[1])
                    np.add.at(total[p], entry, x)
            part, entry = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), *[pa.array(total[part, entry, i]) for i in range(shape[2])]], ["part", "entry", "n", *[f"s{i}" for i in range(shape[2])]])

        found = rows.select("v").mapInArrow(sums, "part int, entry int, n long" + "".join(f", {c} long" for c in columns))
        books = books.copy()
        for r in found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *columns)]).collect():  # a row per entry
            books[r.part, r.entry] = [r[c] // r.n for c in columns]
        shared.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def seeds(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks of the ``entries`` smallest vec_ids, ascending, null last; ties go by the vector."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    lengths = {len(r.v) for r in first} or {0}
    if len(lengths) > 1 or max(lengths) % parts:
        raise ValueError(f"vectors of {sorted(lengths)} components cannot be cut into {parts} equal parts")
    whole = np.array([r.v for r in first], np.int64).reshape(len(first), parts, max(lengths) // parts)
    return np.ascontiguousarray(whole.transpose(1, 0, 2))


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows(vec_id, label, v)`` with code (two hex digits a part) and error (squared distances summed over parts) in place of v."""
    shared = rows.sparkSession.sparkContext.broadcast([kd_tree(b) for b in books])
    length = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(entry, error) for _, entry, error in _assigned(matrix(batch.column("v"), length), shared.value)]
            codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(error for _, error in found))], ["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """One row per sound vector: vec_id, code, error, label_error and codebooks_sha256.

    Vectors that are null or hold a null or non-finite component are left out.
    Components become floor(1024 x); one of 65,536 or more, or a vector whose
    length differs or does not divide into ``parts``, is an error, as its code
    would be wrong.  Each part's codebook starts from the ``entries`` smallest
    vec_ids (null last, ties by vector; fewer vectors give fewer entries) and is
    averaged ``rounds`` times over all vectors; ties go to the lower entry, entries
    without vectors stay.  Repeated rows count each; a null vec_id stays null;
    null labels are one label; other columns are not looked at; an empty table
    gives an empty one.
    """
    spark = embeddings.sparkSession
    small_batches(spark, rows=8192)
    rows = stored(integers(embeddings))
    books = seeds(rows, parts, entries)
    length = books.shape[0] * books.shape[2]
    if books.shape[1]:
        other = F.raise_error(F.concat(F.lit(f"vector of another length than {length}, vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
        rows = rows.withColumn("v", F.when(F.size("v") == length, F.col("v")).otherwise(other.cast("array<int>")))
        books = train(rows, books, rounds)
    coded = stored(assign(rows, books))
    sums = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql(dims: int = 64, parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same by DuckDB, every part against every entry."""
    width = dims // parts
    distance = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(width))
    xs = ", ".join(f"x{i}" for i in range(width))
    cut = " UNION ALL ".join(f"SELECT vec_id, label, {p} AS part, " + ", ".join(f"v[{p * width + i + 1}] AS x{i}" for i in range(width)) + " FROM kept" for p in range(parts))
    mean = lambda i: f"CAST((sum(x{i}) - ((sum(x{i}) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x{i}"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT a.vec_id AS vec_id, a.part AS part, min(({distance}) * {entries} + b.entry) AS best FROM cut a JOIN book{r} b ON a.part = b.part GROUP BY a.vec_id, a.part)")
        if r < rounds:
            steps.append(
                f"mean{r} AS MATERIALIZED (SELECT part, best % {entries} AS entry, {', '.join(map(mean, range(width)))} FROM cut JOIN near{r} USING (vec_id, part) GROUP BY part, best % {entries}), "
                f"book{r + 1} AS MATERIALIZED (SELECT b.part AS part, b.entry AS entry, " + ", ".join(f"coalesce(m.x{i}, b.x{i}) AS x{i}" for i in range(width)) + f" FROM book{r} b LEFT JOIN mean{r} m ON m.part = b.part AND m.entry = b.entry)"
            )
    return f"""
        WITH kept AS MATERIALIZED (
          SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), cut AS MATERIALIZED ({cut}),
        seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}),
        book0 AS MATERIALIZED (SELECT part, entry, {xs} FROM cut JOIN seed USING (vec_id)),
        {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(concat_ws(',', {xs}), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)
    """
