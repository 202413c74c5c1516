"""Blocks of possible pairs, and components of links, without hot tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def block_pairs(df: DataFrame, key: str, item: str, tile: int, spread: str, sizes: DataFrame | None = None) -> DataFrame:
    """All within-key pairs as pairs of tiles: key, a (array of items) and b (null for a tile with itself).

    A key with more than ``tile`` rows is split by hash of ``spread`` into tiles
    of about that many; each pair of its tiles is one row, so no task sees a
    whole key and no pair is emitted.  Keys with one row have no pair and are
    left out, and so are keys that ``sizes`` (key and __n), where it is given, lacks.
    """
    if sizes is None:
        sizes = checkpoint(df.groupBy(key).agg(F.count("*").alias("__n")).filter("__n > 1"))
    parts = df.join(sizes, key).withColumn("__parts", F.ceil(F.col("__n") / tile).cast("int"))
    parts = parts.withColumn("__part", F.pmod(F.xxhash64(F.lit("tile"), spread), F.col("__parts")).cast("int"))
    tiles = checkpoint(parts.groupBy(key, "__part", "__parts").agg(F.collect_list(item).alias("a")))
    alone = tiles.select(key, "a", F.lit(None).cast(tiles.schema["a"].dataType).alias("b"))
    split = tiles.filter("__parts > 1")
    other = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__other")
    dealt = split.select(key, "a", "__part", other).filter("__part <> __other")
    low, high = F.least("__part", "__other"), F.greatest("__part", "__other")
    paired = (
        dealt.groupBy(key, low.alias("__low"), high.alias("__high"))
        .agg(F.collect_list("a").alias("__both"))
        .filter(F.size("__both") == 2)
        .select(key, F.col("__both")[0].alias("a"), F.col("__both")[1].alias("b"))
    )
    return alone.unionByName(paired)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A spanning forest of the links a-b as (least of its component, member) rows."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(names))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    member = root != np.arange(len(names))
    return np.stack([names[root[member]], names[member]], axis=1)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) for every node of ``edges(a, b)``, both long.

    Rounds of least-neighbour labels and pointer jumping until the labels stand
    still; each round is cut by a checkpoint.  Joins read checkpointed tables on
    both sides, so that adaptive execution can split a hot node.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v").filter("u <> v").distinct())
    labels = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")).select(F.col("u").alias("node"), "l"))
    total = None
    while True:
        now = labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels.select("node", F.col("l").alias("root"))
        total = now
        heard = both.join(labels, both["u"] == labels["node"]).select(F.col("v").alias("node"), "l")
        least = checkpoint(heard.union(labels).groupBy("node").agg(F.min("l").alias("l")))
        far = least.select(F.col("node").alias("at"), F.col("l").alias("far"))
        labels = checkpoint(least.join(far, F.col("l") == F.col("at"), "left").select("node", F.coalesce("far", "l").alias("l")))
