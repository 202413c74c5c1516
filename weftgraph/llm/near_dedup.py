"""Near-dedup at an exact shingle Jaccard: op8's SimHash components first, then bands of minima for what lies further apart; texts decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos, pi

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches, unused
from .simhash import near, near_groups, set_fingerprint
from .tokenizer import release


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


def shingles(norm: bytes, words: int = 5) -> set[bytes]:
    """Distinct runs of ``words`` words; a shorter text is one shingle, a blank one has none."""
    if not norm:
        return set()
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    if len(spaces) < words - 1:
        return {norm}
    starts, ends = [0, *(spaces[: len(spaces) + 1 - words] + 1).tolist()], [*spaces[words - 1 :].tolist(), len(norm)]
    return {norm[s:e] for s, e in zip(starts, ends, strict=True)}


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


@cache
def odd_factors(n: int) -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(own: set[bytes], bands: int, rows: int) -> list[int]:
    """One signed 64-bit key per band: two texts agree on a band's ``rows`` minima with Jaccard ** rows."""
    if not own:
        return []
    factors, h = odd_factors(bands * rows), xxhash.xxh64_intdigest
    hashes = np.array([h(s, 42) for s in own], np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * factors).min(axis=0), out=least)
    keys = [h(least[i * rows : (i + 1) * rows].tobytes(), i) for i in range(bands)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest (of the normal form) and keys."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            norms = [normal(t) for t in batch["text"]]
            keys = [band_keys(shingles(n, words), bands, rows) for n in norms]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": [xxhash.xxh3_128_hexdigest(n) for n in norms], "keys": keys})

    return docs.select("doc_id", "text").mapInPandas(make, "doc_id long, digest string, keys array<long>")


def alike(pairs: DataFrame, words: int, least: float) -> DataFrame:
    """hi of the pairs (lo, hi, a, b: ids and texts) whose shingles have a Jaccard of ``least`` or more."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            found, last, first = [], None, set()
            for lo, hi, a, b in zip(batch["lo"], batch["hi"], batch["a"], batch["b"], strict=True):
                if lo != last:
                    last, first = lo, shingles(normal(a), words)
                if jaccard(first, shingles(normal(b), words)) >= least:
                    found.append(hi)
            yield pd.DataFrame({"hi": np.array(found, np.int64)})

    return pairs.select("lo", "hi", "a", "b").mapInPandas(compare, "hi long")


def shared_keys(live: DataFrame) -> DataFrame:
    """The rows of ``live(key, node)`` whose key has two nodes or more."""
    often = checkpoint(live.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("k")))
    return checkpoint(live.join(often, F.col("key") == F.col("k")).select("key", "node"))


def radius(least: float, deviations: float, bits: int = 512) -> int:
    """Bits in which SimHashes of sets with a Jaccard of ``least`` differ, plus so many standard deviations.

    Sets of one size with that Jaccard have a cosine of 2 * least / (1 + least);
    sets of unlike sizes have a greater one, and differ less.
    """
    share = acos(2 * least / (1 + least)) / pi
    return int(bits * share + deviations * (bits * share * (1 - share)) ** 0.5)


def prints(texts: DataFrame, words: int) -> DataFrame:
    """node, size (number of distinct shingles) and fp (512 bits) of ``texts(doc_id, text)``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            own = [shingles(normal(t), words) for t in batch.column("text").to_pylist()]
            sizes, fps = pa.array([len(s) for s in own], pa.int64()), pa.array([set_fingerprint(s) for s in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, fps], ["node", "size", "fp"])

    return texts.select("doc_id", "text").mapInArrow(make, "node long, size long, fp binary")


def tiled(keyed: DataFrame, made: DataFrame, name: str, tile: int) -> DataFrame:
    """``keyed(key, node)`` with size and fp of ``made``, as arrays of about ``tile`` rows of one key each."""
    sizes = checkpoint(keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("tiles")).filter("tiles > 1").select(F.col("key").alias("k"), "tiles"))
    part = F.pmod(F.xxhash64(F.lit("tile"), "node"), F.coalesce("tiles", F.lit(1)))
    dealt = keyed.join(made, "node").join(sizes, F.col("key") == F.col("k"), "left").withColumn("part", part)
    return dealt.groupBy("key", "part").agg(F.collect_list(F.struct("node", "size", "fp")).alias(name)).select("key", name)


def opened(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes, sizes and fingerprints of each array of ``tiled``."""
    node, size, fp = column.flatten().flatten()
    node, size = node.to_numpy(zero_copy_only=False), size.to_numpy(zero_copy_only=False)
    words = np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(len(node), -1)
    ends = np.cumsum([0, *column.value_lengths().to_pylist()])
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        yield node[low:high], size[low:high], words[low:high]


def close_pairs(live: DataFrame, centres: DataFrame, made: DataFrame, least: float, tile: int = 512) -> DataFrame:
    """lo and hi of the nodes and centres of one key that may have a Jaccard of ``least`` or more.

    A pair is left out where one set is too small for the other, or where the
    SimHashes differ in more bits than such a pair's do with all but a chance of
    one in some ten thousand.  Tiles are compared as wholes, by bit planes; only
    pairs that pass become rows.
    """
    wide, narrow = radius(least, 9.0), radius(least, 4.75)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi, held = [], [], 0
            for (node, size, fp), (c, c_size, c_fp) in zip(opened(batch.column("a")), opened(batch.column("c")), strict=True):
                # in sets of a few shingles a bit is often a draw that one more shingle turns
                limit = wide if min(size.min(), c_size.min()) < 8 else narrow
                if len(node) * len(c) <= 4096:
                    q, v = np.nonzero(np.bitwise_count(fp[:, None] ^ c_fp[None]).sum(axis=2, dtype=np.int64) <= limit)
                else:
                    q, v = near(fp, c_fp, limit)
                fit = (node[q] != c[v]) & (np.minimum(size[q], c_size[v]) >= least * np.maximum(size[q], c_size[v]) - 1e-9)
                one, other = node[q[fit]], c[v[fit]]
                lo.append(np.minimum(one, other))
                hi.append(np.maximum(one, other))
                held += len(one)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lo)), pa.array(np.concatenate(hi))], ["lo", "hi"])
                    lo, hi, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lo)), pa.array(np.concatenate(hi))], ["lo", "hi"])

    nodes = tiled(live, made, "a", tile)
    chosen = tiled(centres.toDF("key", "node"), made, "c", tile)
    met = nodes.join(chosen.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("a", "c")
    return met.mapInArrow(compare, "lo long, hi long").distinct()


def component_copies(texts: DataFrame, words: int, least: float) -> DataFrame:
    """hi: the documents of ``texts(doc_id, text)`` whose SimHash component (op8's: 64 bits, links of 3 or fewer) has a smaller one that they are ``alike``."""
    groups = near_groups(texts).filter("doc_id <> component_id").select(F.col("component_id").alias("lo"), F.col("doc_id").alias("hi"))
    # The member's text first, so that the one text of a large component's head is not carried along.
    full = checkpoint(groups).join(texts.toDF("j", "b"), F.col("hi") == F.col("j")).drop("j").join(texts.toDF("i", "a"), F.col("lo") == F.col("i"))
    return checkpoint(alike(full, words, least).distinct())


def near_copies(named: DataFrame, words: int, least: float, bands: int, rows: int) -> DataFrame:
    """doc_id of the documents that go; ``named`` has each doc_id once and none null.

    Texts of one normal form leave the smallest doc_id.  Of those, the members of a
    SimHash component that are alike its smallest one go first: op8's method, with
    the exact check behind it.  Of the rest, two that meet in a band are compared, and the larger doc_id goes.  Each round compares some
    documents of every band with all others in it, takes these and all that go out
    of the bands, and takes more in the next round, until no band has two.  So no
    two that stay meet in a band and are alike.  The first round has one document
    a band and compares texts; from then on SimHashes choose whose texts are.
    """
    sketched = checkpoint(sketches(named, words, bands, rows))
    firsts = checkpoint(sketched.groupBy("digest").agg(F.min("doc_id").alias("node")))
    copies = sketched.select("doc_id", "digest").join(firsts, "digest").filter("doc_id <> node").select("doc_id")
    alone = firsts.select(F.col("node").alias("doc_id"))
    linked = component_copies(named.select("doc_id", "text").join(alone, "doc_id", "semi"), words, least).toDF("doc_id")
    gone = [checkpoint(copies), linked]
    keyed = sketched.join(alone, "doc_id").join(linked, "doc_id", "anti").select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"))
    live = shared_keys(checkpoint(keyed))
    texts = checkpoint(named.select("doc_id", "text").join(live.select(F.col("node").alias("doc_id")).distinct(), "doc_id"))
    parts, made = 1, None
    while live.limit(1).count():
        part = F.pmod(F.xxhash64("node"), F.lit(parts))
        centres = checkpoint(live.groupBy("key", part.alias("part")).agg(F.min("node").alias("c")).select(F.col("key").alias("k"), "c"))
        if parts == 1:
            met = live.join(centres, F.col("key") == F.col("k")).filter("node <> c")
            pairs = checkpoint(met.select(F.least("node", "c").alias("lo"), F.greatest("node", "c").alias("hi")).distinct())
        else:
            if made is None:
                made = checkpoint(prints(texts.join(live.select(F.col("node").alias("doc_id")).distinct(), "doc_id"), words))
            pairs = checkpoint(close_pairs(live, centres, made, least))
        full = pairs.join(texts.toDF("i", "a"), F.col("lo") == F.col("i")).drop("i").join(texts.toDF("j", "b"), F.col("hi") == F.col("j"))
        dropped = checkpoint(alike(full, words, least).distinct())
        gone.append(dropped.toDF("doc_id"))
        left = live.join(centres, (F.col("key") == F.col("k")) & (F.col("node") == F.col("c")), "anti")
        live = shared_keys(checkpoint(left.join(dropped, F.col("node") == F.col("hi"), "anti")))
        parts *= 16
    out = gone[0]
    for more in gone[1:]:
        out = out.union(more)
    return out.distinct()


def keep_unlike(docs: DataFrame, words: int = 5, least: float = 0.8, bands: int = 24, rows: int = 6) -> DataFrame:
    """``docs`` without the documents that have a near copy of smaller doc_id.

    A near copy shares ``least`` or more of both texts' distinct shingles (exact
    Jaccard); two such meet in one of ``bands`` bands with a probability of
    1 - (1 - least ** rows) ** bands or more, 0.9993 as set.  Blank texts are
    copies of each other.  Rows that repeat a doc_id are one document and stay
    once.  Rows without a doc_id cannot be told from each other and all stay.
    Columns are as in ``docs``, whatever they are called; an empty table gives an
    empty one.
    """
    named = docs.filter("doc_id is not null")
    if named.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        named = checkpoint(named.dropDuplicates(["doc_id"]))
    gone = checkpoint(near_copies(named, words, least, bands, rows))
    own = unused(docs.columns, "own_id")
    kept = named.join(gone.select(F.col("doc_id").alias(own)), F.col("doc_id") == F.col(own), "anti")
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)
