"""Findings: orphans, uncovered requirements, coverage, drift and the baseline difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def orphans(graph: Graph) -> DataFrame:
    """implements and verifies edges, not from tasks, whose target is no node: source, target, kind and key text."""
    claims = graph.claims("implements").unionByName(graph.claims("verifies"))
    # Nodes stream past the few distinct targets, so that no task sorts its share of all nodes.
    targets = claims.select("target").distinct().hint("shuffle_hash")
    known = graph.nodes.select(F.col("id").alias("target")).join(targets, "target", "semi")
    lost = claims.join(known, "target", "anti")
    return lost.select("source", "target", "kind", F.format_string("%s -> %s (%s)", "source", "target", "kind").alias("text")).distinct()


def claimed(graph: Graph) -> DataFrame:
    """Ids that some claim implements."""
    return graph.claims().select(F.col("target").alias("req_id")).distinct()


def uncovered(graph: Graph) -> DataFrame:
    """Requirements that nothing but tasks implements."""
    return graph.kinds("req").select(F.col("id").alias("req_id")).join(claimed(graph), "req_id", "anti")


def coverage(graph: Graph, results: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Per requirement: status and the sorted sources that implement and verify it.

    ``results(req_id, passed)``: without them a tested requirement is verified;
    with them all of its results must have passed, and there must be one.
    ``evidence(req_id, node_id)``: with it an unclaimed requirement that alone
    reaches some node is exercised.
    """

    empty = F.array().cast("array<string>")
    out = _standing(graph, F.array_sort(F.collect_set("source")), results, evidence)
    return out.select("req_id", "status", F.coalesce("implementing", empty).alias("impl_files"), F.coalesce("verifying", empty).alias("test_files"))


def _standing(graph: Graph, held: Column, results: DataFrame | None, evidence: DataFrame | None) -> DataFrame:
    """req_id, status, and ``held`` of the sources that implement and verify it, null where none does."""

    def sources(kind: str, name: str) -> DataFrame:
        return graph.claims(kind).groupBy(F.col("target").alias("req_id")).agg(held.alias(name))

    out = graph.kinds("req").select(F.col("id").alias("req_id")).join(sources("implements", "implementing"), "req_id", "left").join(sources("verifies", "verifying"), "req_id", "left")
    passed: Column = F.lit(True)
    if results is not None:
        out = out.join(results.groupBy("req_id").agg(F.bool_and("passed").alias("all_passed")), "req_id", "left")
        passed = F.coalesce("all_passed", F.lit(False))
    rescued: Column = F.lit(False)
    if evidence is not None:
        alone = exclusive(evidence).select("req_id").distinct().withColumn("alone", F.lit(True))
        out = out.join(alone, "req_id", "left")
        rescued = F.coalesce("alone", F.lit(False))
    status = (
        F.when(F.col("implementing").isNull() & rescued, "exercised")
        .when(F.col("implementing").isNull(), "untagged")
        .when(F.col("verifying").isNull() | ~passed, "impl-only")
        .otherwise("verified")
    )
    return out.select("req_id", status.alias("status"), "implementing", "verifying")


def exclusive(evidence: DataFrame) -> DataFrame:
    """node_id and req_id where exactly one requirement reaches the node."""
    return evidence.groupBy("node_id").agg(F.countDistinct("req_id").alias("n"), F.min("req_id").alias("req_id")).filter("n = 1").select("node_id", "req_id")


def drift(graph: Graph, lock: DataFrame) -> DataFrame:
    """Locked nodes whose content has changed since."""
    locked = lock.select(F.col("id").alias("node_id"), F.col("content_hash").alias("locked_hash"))
    now = graph.nodes.select(F.col("id").alias("node_id"), "kind", F.col("content_hash").alias("current_hash"))
    return now.join(locked.hint("shuffle_hash"), "node_id").filter("locked_hash <> current_hash").select("node_id", "kind", "locked_hash", "current_hash")


def stale_keys(graph: Graph, lock: DataFrame) -> DataFrame:
    """Lock keys without a node; a scope never narrows them."""
    return lock.select("id").join(graph.nodes.select("id"), "id", "anti")


def issues(graph: Graph, lock: DataFrame, scope: DataFrame | None = None, results: DataFrame | None = None, evidence: DataFrame | None = None, renames: DataFrame | None = None) -> DataFrame:
    """category, id and identity key of every finding; ``scope(id)`` narrows all but test failures' inputs alike.

    ``renames(old_path, new_path)`` moves orphan sources to their new path, for
    the baseline side of a difference.
    """

    def within(df: DataFrame, column: str) -> DataFrame:
        return df if scope is None else df.join(scope.select(F.col("id").alias(column)), column, "semi")

    moved = within(drift(graph, lock), "node_id")
    drifted = moved.select(F.lit("drift").alias("category"), F.col("node_id").alias("id"), F.concat(F.lit("drift:"), F.to_json(F.array("node_id", "current_hash"))).alias("key"))
    lost = within(orphans(graph), "source")
    if renames is not None:
        lost = renamed_sources(lost, renames)
    orphaned = lost.select(F.lit("orphan").alias("category"), F.col("source").alias("id"), F.concat(F.lit("orphan:"), "text").alias("key"))
    # Counts, not lists: a requirement may have any number of sources.
    covered = within(_standing(graph, F.count("*"), results, evidence), "req_id")
    bare = covered.filter("status = 'untagged'").select(F.lit("uncovered").alias("category"), F.col("req_id").alias("id"), F.concat(F.lit("uncovered:"), "req_id").alias("key"))
    out = drifted.unionByName(orphaned).unionByName(bare)
    if results is not None:
        failed = covered.filter((F.col("status") == "impl-only") & F.col("verifying").isNotNull())
        out = out.unionByName(failed.select(F.lit("testfail").alias("category"), F.col("req_id").alias("id"), F.concat(F.lit("testfail:"), "req_id").alias("key")))
    return out


def renamed_sources(lost: DataFrame, renames: DataFrame) -> DataFrame:
    """Orphans with file: and symbol: sources moved to the renamed path."""
    from ..graph import owner_path

    moved = lost.withColumn("old_path", owner_path(F.col("source"))).join(renames, "old_path", "left")
    file = F.concat(F.lit("file:"), "new_path")
    symbol = F.concat(F.lit("symbol:"), "new_path", F.lit("#"), F.regexp_extract("source", r"#([^#]*)$", 1))
    source = F.when(F.col("new_path").isNull(), F.col("source")).when(F.col("source").startswith("file:"), file).otherwise(symbol)
    out = moved.withColumn("source", source)
    return out.select("source", "target", "kind", F.format_string("%s -> %s (%s)", "source", "target", "kind").alias("text"))


def check(current: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """``current`` issues with is_new: their key is not among the baseline's.

    A baseline has no test-failure keys, so failures always are new.  Without a
    baseline every issue is new.
    """
    if baseline is None:
        return current.withColumn("is_new", F.lit(True))
    known = baseline.filter("category <> 'testfail'").select("key").distinct().withColumn("known", F.lit(True))
    return current.join(known, "key", "left").select("category", "id", "key", F.col("known").isNull().alias("is_new"))


def summary(checked: DataFrame) -> DataFrame:
    """One row: number of issues, of new ones, of suppressed ones, and whether the check passes."""
    return checked.agg(
        F.count("*").alias("n_issues"), F.count_if(F.col("is_new")).alias("n_new"), F.count_if(~F.col("is_new")).alias("n_suppressed"), (F.count_if(F.col("is_new")) == 0).alias("passes")
    )


def orphan_docs(graph: Graph) -> DataFrame:
    """Documents that no edge touches."""
    touched = graph.edges.select(F.col("source").alias("id")).union(graph.edges.select("target")).distinct()
    return graph.kinds("doc").select("id").join(touched, "id", "anti")


def would_be_exercised(graph: Graph, results: DataFrame | None, evidence: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Uncovered requirements that evidence would cover if it were accepted."""
    bare = uncovered(graph) if scope is None else uncovered(graph).join(scope.select(F.col("id").alias("req_id")), "req_id", "semi")
    return coverage(graph, results, evidence).filter("status = 'exercised'").select("req_id").join(bare, "req_id", "semi")


def without_ignored(checked: DataFrame, ignored: DataFrame) -> DataFrame:
    """``checked`` with the new uncovered requirements of ``ignored(id)`` no longer new."""
    mark = ignored.select("id", F.lit(True).alias("skip")).distinct()
    skip = (F.col("category") == "uncovered") & F.coalesce("skip", F.lit(False))
    return checked.join(mark, "id", "left").withColumn("is_new", F.col("is_new") & ~skip).select(checked.columns)


def dangling_code_tags(graph: Graph) -> DataFrame:
    """Code tags whose requirement is no node; their being there is the flag."""
    tags = graph.edges_of("implements", "verifies").filter(F.array_contains("provenances", "code-tag"))
    return tags.join(graph.nodes.select(F.col("id").alias("target")), "target", "anti").select("source", "target", "kind")
