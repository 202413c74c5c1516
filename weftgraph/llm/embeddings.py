"""Embedding near-dedup with spherical-cap filters from random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, small_batches
from .links import block_pairs, components, forest


class Caps:
    """Filters of one dimension: every choice of a code from each of four runs of coordinates.

    A vector lies in a filter's cap if its cosine with the filter's direction is
    ``height`` or more.  ``height`` is set so that a random vector lies in about
    ``caps`` of the codes**4 caps; a vector in fewer than ``least`` lowers its
    own bar until it has that many.
    """

    RUNS = 4

    def __init__(self, dim: int, codes: int, caps: float, least: int, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.codes, self.least = codes, least
        self.cuts = [dim * i // self.RUNS for i in range(self.RUNS + 1)]
        self.books = []
        for lo, hi in zip(self.cuts, self.cuts[1:], strict=False):
            book = rng.standard_normal((codes, hi - lo))
            norm = np.linalg.norm(book, axis=1, keepdims=True) if hi > lo else 1.0
            self.books.append(book / norm / math.sqrt(self.RUNS))
        share = min(0.5, caps / codes**self.RUNS)
        self.height = NormalDist().inv_cdf(1 - share) / math.sqrt(dim)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each row: halves of the code are summed, and joined best first as far as the bar allows."""
        parts = [unit[:, lo:hi] @ book.T for lo, hi, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]
        left = (parts[0][:, :, None] + parts[1][:, None, :]).reshape(len(unit), -1)
        right = (parts[2][:, :, None] + parts[3][:, None, :]).reshape(len(unit), -1)
        by_left, by_right = np.argsort(-left, axis=1, kind="stable"), np.argsort(-right, axis=1, kind="stable")
        out, square = [], self.codes * self.codes
        for i in range(len(unit)):
            a, b = left[i, by_left[i]], right[i, by_right[i]]
            bar, need = self.height, min(self.least, square * square)
            while True:
                open_ = a[: np.searchsorted(-a, b[0] - bar, side="right")]
                fits = np.searchsorted(-b, open_ - bar, side="right")
                if fits.sum() >= need:
                    break
                bar -= 0.01
            ends = np.cumsum(fits)
            within = np.arange(ends[-1]) - np.repeat(ends - fits, fits)
            out.append(np.sort(np.repeat(by_left[i, : len(open_)], fits) * square + by_right[i, within]))
        return out


@cache
def caps_of(dim: int, codes: int, caps: float, least: int) -> Caps:
    return Caps(dim, codes, caps, least)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def valid(vector: str = "embedding"):
    """Not null or empty, no null or non-finite component, and not zero."""
    big = float("inf")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def caps_for(count: int) -> float:
    """How many caps a vector should lie in: 12 up to 50,000 vectors, 1.5 more for each doubling, as more filters make caps smaller and shared ones rarer."""
    return 12.0 + 1.5 * max(0.0, math.log2(max(1, count) / 50_000))


def filter_links(distinct: DataFrame, count: int, least_cosine: float, caps: float | None = None, least: int | None = None, bucket: int = 16, tile: int = 256) -> DataFrame:
    """node, n (vectors linked to it, copies included) and root (a spanning link, or null), a row per node and tile.

    ``distinct`` has node, copies and embedding.  Vectors of one dimension meet
    in the caps that they share, are verified in double precision, and a link is
    counted in the first cap that both lie in, so no pair is ever emitted.
    """
    caps = caps_for(count) if caps is None else caps
    least = math.ceil(caps * 2 / 3) if least is None else least
    kind = np.float64 if isinstance(distinct.schema["embedding"].dataType.elementType, T.DoubleType) else np.float32
    codes = max(4, math.ceil((count * caps / bucket) ** 0.25))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["embedding"].map(len)
            for dim, rows in batch.groupby(dims):
                vectors = np.stack(rows["embedding"].to_numpy()).astype(kind)
                caps_in = caps_of(int(dim), codes, caps, least).decode(unit_rows(vectors))
                nodes, copies = rows["node"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64)
                items = [nodes[i].tobytes() + copies[i].tobytes() + vectors[i].tobytes() for i in range(len(rows))]
                sizes = [len(c) for c in caps_in]
                at = np.repeat(np.arange(len(rows)), sizes)
                yield pd.DataFrame({"dim": int(dim), "cap": np.concatenate(caps_in), "node": nodes[at], "item": [items[i] for i in at]})

    def unpack(items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = len(items[0])
        table = np.frombuffer(b"".join(items), np.uint8).reshape(-1, width)
        head = np.ascontiguousarray(table[:, :16]).view(np.int64)
        return head[:, 0], head[:, 1], np.ascontiguousarray(table[:, 16:]).view(kind)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (dim, cap), first, second in zip(batch["key"].map(lambda k: (k["dim"], k["cap"])), batch["a"], batch["b"], strict=True):
                alone = second is None
                nodes, copies, vectors = unpack(first)
                unit = unit_rows(vectors)
                if alone:
                    nodes2, copies2, unit2 = nodes, copies, unit
                else:
                    nodes2, copies2, vectors2 = unpack(second)
                    unit2 = unit_rows(vectors2)
                i, j = np.nonzero(unit @ unit2.T >= least_cosine)
                if alone:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                # Links of which both ends share an earlier cap are counted there.
                caps_of_dim = caps_of(int(dim), codes, caps, least)
                ui, at_i = np.unique(i, return_inverse=True)
                uj, at_j = np.unique(j, return_inverse=True)
                lists = [[c[c < cap] for c in caps_of_dim.decode(u)] for u in (unit[ui], unit2[uj])]
                names = np.unique(np.concatenate([*lists[0], *lists[1]]))
                if len(names):
                    marks = []
                    for own in lists:
                        m = np.zeros((len(own), len(names)), np.float32)
                        for r, c in enumerate(own):
                            m[r, np.searchsorted(names, c)] = 1
                        marks.append(m)
                    fresh = (marks[0] @ marks[1].T)[at_i, at_j] == 0
                    i, j = i[fresh], j[fresh]
                    if not len(i):
                        continue
                a, b = nodes[i], nodes2[j]
                ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([copies2[j], copies[i]]).astype(float)).astype(np.int64)
                tree = forest(a, b)
                root = pd.Series(tree[:, 0], index=tree[:, 1], dtype="Int64").reindex(ids)
                yield pd.DataFrame({"node": ids, "n": n, "root": root.to_numpy()})

    decoded = distinct.mapInPandas(decode, "dim int, cap long, node long, item binary")
    keyed = decoded.select(F.struct("dim", "cap").alias("key"), "node", "item")
    return block_pairs(checkpoint(keyed), "key", "item", tile, "node").mapInPandas(verify, "node long, n long, root long")


def near_vectors(embeddings: DataFrame, least_cosine: float = 0.95, **options) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept.

    Vectors that are null, empty, zero, or hold a null or non-finite component
    link with nothing and stay.  Copies of a vector are one node and count each
    other as links; they are told by two 64-bit hashes of all components.  Links
    found have a cosine of ``least_cosine`` or more; filters may miss a few (recall
    is measured in the tests).  A component with null ids only has a null
    component_id and its rows stay; rows that repeat a vec_id each have a row in
    the result, and all of those with the component's id are kept; other columns
    are not looked at; an empty table gives an empty one.
    """
    small_batches(embeddings.sparkSession, rows=2048)
    hashes = [F.when(valid(), F.xxhash64("embedding")).alias("h1"), F.when(valid(), F.xxhash64(F.lit(29), "embedding")).alias("h2")]
    rows = embeddings.select("vec_id", "embedding", *hashes)
    hashed = checkpoint(rows.select("vec_id", "h1", "h2"))
    once = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.any_value("embedding").alias("embedding"))
    numbered = checkpoint(once.withColumn("node", F.monotonically_increasing_id()))
    distinct = numbered.select("node", "copies", "first", "embedding")
    own = numbered.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "node")
    slim = checkpoint(hashed.join(own, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left").select("vec_id", "node"))
    parts = checkpoint(filter_links(distinct, distinct.count(), least_cosine, **options))
    counts = parts.groupBy("node").agg(F.sum("n").alias("n")).withColumnRenamed("node", "linked")
    found = components(parts.filter(F.col("root").isNotNull()).select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = distinct.select("node", "copies", "first")
    led = nodes.join(counts, nodes["node"] == counts["linked"], "left").join(found.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    led = checkpoint(led.select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"), "first"))
    least = checkpoint(led.groupBy("root").agg(F.min("first").alias("component_id")))
    named = checkpoint(led.join(least, "root").select(F.col("node").alias("own"), "n_links", "component_id"))
    lone = slim.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    tied = slim.filter("node is not null").join(named, F.col("node") == F.col("own")).select("vec_id", "n_links", "component_id")
    return tied.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
