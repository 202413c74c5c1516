"""Hierarchical weighted hash tree: rows descend region, rack and shard levels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_rows, unused


@dataclass(frozen=True)
class Node:
    """A node of the tree.  A leaf has a shard number; an inner node weighs what its leaves weigh."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())

    @property
    def total(self) -> float:
        return self.weight if self.shard is not None else sum(c.total for c in self.children)

    def leaves(self) -> list[Node]:
        return [self] if self.shard is not None else [x for c in self.children for x in c.leaves()]


def shard_tree(shards: int, base: int = 8, racks: int = 2, per_rack: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Region, rack and shard levels over ``shards`` shards.

    The first ``base`` shards fill racks of ``per_rack`` and regions of
    ``racks`` racks.  Each later shard opens a region of its own, which leaves
    every other region's weight as it was: growth by one shard then moves rows
    only into that shard, whatever the count.
    """
    weights = weights or {}
    leaf = lambda i: Node(f"shard{i}", float(weights.get(i, 1.0)), shard=i)
    regions = []
    for r, at in enumerate(range(0, min(shards, base), racks * per_rack)):
        inside = range(at, min(at + racks * per_rack, shards, base))
        rack_of = [list(inside[i : i + per_rack]) for i in range(0, len(inside), per_rack)]
        regions.append(Node(f"region{r}", children=tuple(Node(f"region{r}/rack{k}", children=tuple(leaf(i) for i in ids)) for k, ids in enumerate(rack_of))))
    regions += [Node(f"own{i}", children=(Node(f"own{i}/rack0", children=(leaf(i),)),)) for i in range(base, shards)]
    return Node("root", children=tuple(regions))


def draw(key: Column, node: Node) -> Column:
    """An exponential variate of rate ``node.total``: the least of them wins with probability in proportion to weight."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11)
    return -F.log((bits + 0.5) / F.lit(float(1 << 53))) / F.lit(node.total)


def descend(key: Column, node: Node) -> Column:
    """The path that ``key`` takes below ``node``, as struct(region, rack, shard) of names and the shard's number."""

    def walk(at: Node, names: tuple[str, ...]) -> Column:
        if at.shard is not None:
            region, rack = (*names, "", "")[:2]
            return F.struct(F.lit(region).alias("region"), F.lit(rack).alias("rack"), F.lit(at.shard).alias("shard"))
        live = [c for c in at.children if c.total > 0]
        if len(live) == 1:
            return walk(live[0], (*names, live[0].name))
        best = F.array_min(F.array(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)]))["i"]
        out = walk(live[-1], (*names, live[-1].name))
        for i in range(len(live) - 2, -1, -1):
            out = F.when(best == i, walk(live[i], (*names, live[i].name))).otherwise(out)
        return out

    return walk(node, ())


def shard_rows(df: DataFrame, tree: Node, grown: Node | None = None, key: str = "doc_id") -> DataFrame:
    """``df`` with region, rack and shard, and grown_shard under ``grown``.

    Each level draws one hash per child and takes the least of -ln(u)/weight.  A
    change of weights moves rows only between subtrees on the changed path, and
    only as many as the weights ask for.  A map over the rows: no shuffle.

    Null keys: all take one path (the draw of a null).  Repeated keys share a
    shard.  An empty table gives an empty one.  Existing columns of the output
    names are replaced.
    """
    path = unused(df.columns, "path")
    out = df.withColumn(path, descend(F.col(key), tree))
    out = out.withColumns({name: F.col(path)[name] for name in ("region", "rack", "shard")})
    if grown is not None:
        out = out.withColumn("grown_shard", descend(F.col(key), grown)["shard"])
    return out.drop(path)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document with its shard, its place there and its shard after growth by one.

    Null text: size 1 (no bytes) and the checksum of no bytes.  Null doc_id: see
    ``shard_rows``.  Repeated rows each get a slot.  Only doc_id, size and
    checksum are shuffled, never text.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = shard_rows(slim, shard_tree(shards), shard_tree(shards + 1))
    numbered = number_rows(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard", "region", "rack")
