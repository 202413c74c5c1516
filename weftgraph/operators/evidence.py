"""Execution evidence: staleness, merge into the graph, and claim-versus-evidence classification.

``evidence`` has req_id, node_id; ``hashes`` has node_id and the owning file's hash when traced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, Levels, checkpoint, large, owner_path
from .findings import claimed, exclusive


def stale_nodes(graph: Graph, hashes: DataFrame) -> DataFrame:
    """Ids whose owning file has another hash now, or is gone."""
    traced = hashes.select(F.col("node_id").alias("id"), F.col("hash").alias("traced"), F.concat(F.lit("file:"), owner_path(F.col("node_id"))).alias("owner")).filter("owner is not null")
    now = graph.nodes.select(F.col("id").alias("owner"), F.col("content_hash").alias("now"))
    return traced.join(now, "owner", "left").filter("now is null or now <> traced").select("id").distinct()


def fresh(evidence: DataFrame, stale: DataFrame) -> DataFrame:
    """``evidence`` without stale nodes."""
    return evidence.join(stale.select(F.col("id").alias("node_id")), "node_id", "anti").select(evidence.columns)


def stale_by_requirement(evidence: DataFrame, stale: DataFrame) -> DataFrame:
    """Per requirement, its stale nodes in order."""
    hit = evidence.join(stale.select(F.col("id").alias("node_id")), "node_id", "semi")
    return hit.groupBy("req_id").agg(F.array_sort(F.collect_set("node_id")).alias("stale_nodes"))


def on_graph(graph: Graph, evidence: DataFrame) -> DataFrame:
    """``evidence`` on node ids of the graph: itself, else its owning file, else left out."""
    ids = graph.nodes.select("id")
    here = evidence.join(ids.withColumnRenamed("id", "node_id"), "node_id", "semi").select("req_id", "node_id")
    gone = evidence.join(ids.withColumnRenamed("id", "node_id"), "node_id", "anti").withColumn("node_id", F.concat(F.lit("file:"), owner_path(F.col("node_id"))))
    return here.union(gone.join(ids.withColumnRenamed("id", "node_id"), "node_id", "semi").select("req_id", "node_id")).distinct()


def off_graph(graph: Graph, evidence: DataFrame) -> DataFrame:
    """One row: pairs of ``evidence`` that were moved to their owning file, and pairs that are on no node at all."""
    ids = graph.nodes.select("id")
    gone = evidence.select("req_id", "node_id").distinct().join(ids.withColumnRenamed("id", "node_id"), "node_id", "anti").withColumn("owner", F.concat(F.lit("file:"), owner_path(F.col("node_id"))))
    at = gone.join(ids.select(F.col("id").alias("owner"), F.lit(True).alias("there")), "owner", "left")
    return at.agg(F.count_if(F.col("there")).alias("moved"), F.count_if(F.col("there").isNull()).alias("lost"))


def evidence_edges(graph: Graph, evidence: DataFrame) -> DataFrame:
    """Edges to add: coverage provenance on a declared implements pair, else an exercises edge."""
    declared = graph.edges_of("implements").select(F.col("source").alias("node_id"), F.col("target").alias("req_id"), F.lit(True).alias("declared")).distinct()
    out = on_graph(graph, evidence).join(declared, ["node_id", "req_id"], "left")
    swap = F.col("declared").isNotNull()
    pick = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    return out.select(
        pick("node_id", "req_id").alias("source"),
        pick("req_id", "node_id").alias("target"),
        F.when(swap, "implements").otherwise("exercises").alias("kind"),
        F.array(F.lit("coverage")).alias("provenances"),
        F.lit(None).cast("string").alias("target_space"),
    )


def containment(graph: Graph, ends: DataFrame | None = None) -> DataFrame:
    """ancestor and descendant over contains edges, at least one step; cycles end.

    With ``ends(id)`` only pairs that descend from one of them or lead up to one:
    the walk starts there, down and up, so the rest of the graph is never closed.
    """
    spark = graph.nodes.sparkSession
    steps = graph.edges_of("contains").select(F.col("source").alias("ancestor"), F.col("target").alias("descendant")).distinct()
    steps = checkpoint(steps)

    def walk(first: DataFrame, near: str, far: str) -> DataFrame:
        """Pairs of a fixed end ``far`` and what further steps lead to at ``near``."""
        levels = Levels(spark, first.schema)
        found = levels.add(first)
        onward = steps.select(F.col(far).alias("middle"), F.col(near).alias("next"))
        while found:
            last = levels.last().withColumnRenamed(near, "middle").join(large(onward), "middle").select(far, F.col("next").alias(near)).distinct()
            found = levels.add(last.join(large(levels.all()), [near, far], "anti"))
        return levels.all()

    if ends is None:
        return walk(steps, "descendant", "ancestor")
    own = ends.select("id").distinct()
    down = walk(steps.join(large(own.withColumnRenamed("id", "ancestor")), "ancestor", "semi"), "descendant", "ancestor")
    up = walk(steps.join(large(own.withColumnRenamed("id", "descendant")), "descendant", "semi"), "ancestor", "descendant")
    return down.unionByName(up).distinct()


def classify(graph: Graph, evidence: DataFrame, shared_threshold: int = 5) -> DataFrame:
    """class, req_id, node_id and n_reqs.

    corroborated and unexercised split the implements edges (tasks' too) by
    whether evidence of the requirement reaches the node or something in it, or,
    for a constructor, its direct container.  infrastructure: unclaimed nodes of
    ``shared_threshold`` requirements or more (req_id null).  suggested: nodes of
    one unclaimed requirement with no claim of it above or below.
    """
    pairs = large(evidence.select("req_id", "node_id").distinct())
    claims = large(graph.edges_of("implements").select(F.col("target").alias("req_id"), F.col("source").alias("node_id")).distinct())
    inside = large(containment(graph, claims.select(F.col("node_id").alias("id")).union(pairs.select("node_id"))))
    below = claims.join(inside.select(F.col("ancestor").alias("node_id"), "descendant"), "node_id").join(pairs.withColumnRenamed("node_id", "descendant"), ["req_id", "descendant"], "semi").select("req_id", "node_id")
    direct = large(graph.edges_of("contains").select(F.col("source").alias("parent"), F.col("target").alias("node_id")))
    built = claims.filter(F.col("node_id").startswith("symbol:") & F.col("node_id").endswith(".constructor"))
    built = built.join(direct, "node_id").join(pairs.withColumnRenamed("node_id", "parent"), ["req_id", "parent"], "semi").select("req_id", "node_id")
    proven = claims.join(pairs, ["req_id", "node_id"], "semi").union(below).union(built).distinct().withColumn("proven", F.lit(True))
    told = claims.join(large(proven), ["req_id", "node_id"], "left").select(F.when(F.col("proven"), "corroborated").otherwise("unexercised").alias("class"), "req_id", "node_id", F.lit(None).cast("long").alias("n_reqs"))
    counts = pairs.groupBy("node_id").agg(F.count("*").alias("n_reqs"))
    shared = counts.filter(F.col("n_reqs") >= shared_threshold).join(claims.select("node_id"), "node_id", "anti")
    infrastructure = shared.select(F.lit("infrastructure").alias("class"), F.lit(None).cast("string").alias("req_id"), "node_id", "n_reqs")
    alone = exclusive(pairs) if shared_threshold > 1 else exclusive(pairs).limit(0)
    alone = large(alone.join(large(claimed(graph)), "req_id", "anti"))
    above = alone.join(inside.select("ancestor", F.col("descendant").alias("node_id")), "node_id").join(claims.withColumnRenamed("node_id", "ancestor"), ["req_id", "ancestor"], "semi")
    under = alone.join(inside.select(F.col("ancestor").alias("node_id"), "descendant"), "node_id").join(claims.withColumnRenamed("node_id", "descendant"), ["req_id", "descendant"], "semi")
    free = alone.join(large(above.select("req_id", "node_id").union(under.select("req_id", "node_id")).distinct()), ["req_id", "node_id"], "anti")
    suggested = free.select(F.lit("suggested").alias("class"), "req_id", "node_id", F.lit(None).cast("long").alias("n_reqs"))
    return told.unionByName(infrastructure).unionByName(suggested)


def status(tests: DataFrame, skipped: DataFrame, hashes: DataFrame, stale: DataFrame, shards: int) -> DataFrame:
    """One row: shards, tests, tagged tests, skipped records and the share of traced nodes that are stale (0 without any)."""
    n_tests = tests.agg(F.count("*").alias("n_tests"), F.count_if(F.size("req_ids") > 0).alias("n_tagged"))
    n_skipped = skipped.agg(F.count("*").alias("n_skipped"))
    traced = hashes.agg(F.countDistinct("node_id").alias("n_traced"))
    old = stale.agg(F.count("*").alias("n_stale"))
    out = n_tests.crossJoin(n_skipped).crossJoin(traced).crossJoin(old)  # four single rows
    return out.select(F.lit(shards).alias("n_shards"), "n_tests", "n_tagged", "n_skipped", F.coalesce(F.try_divide("n_stale", "n_traced"), F.lit(0.0)).alias("stale_rate"))
