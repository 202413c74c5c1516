"""Canonical form: edge dedup with provenance union, last-writer nodes, ids and structural edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PROVENANCES, Graph


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, kind), provenances united and sorted; map-side combined."""
    return edges.groupBy("source", "target", "kind").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("provenances")))).alias("provenances"), F.max("target_space").alias("target_space")
    )


def union_dependencies(deps: DataFrame, key: str, target: str) -> DataFrame:
    """Per (key, target): the sorted union of provenances."""
    return deps.groupBy(key, target).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("provenances")))).alias("provenances"))


def last_nodes(nodes: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The last written node of each id by ``seq``; and warnings for ids that come from two files or more."""
    row = F.struct(*[c for c in nodes.columns if c != "id"])
    kept = nodes.groupBy("id").agg(F.max_by(row, seq).alias("row")).select("id", *[F.col(f"row.{c}").alias(c) for c in nodes.columns if c not in ("id", seq)])
    warned = nodes.groupBy("id").agg(F.array_sort(F.collect_set("file_path")).alias("files")).filter(F.size("files") > 1)
    return kept, warned.select(F.lit("duplicate-id").alias("type"), "id", "files")


def kind_counts(graph: Graph) -> DataFrame:
    """Nodes and edges by kind."""
    nodes = graph.nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    edges = graph.edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n")
    return nodes.unionByName(edges)


def exported(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes with label defaulting to id, and edges with at least one known provenance."""
    nodes = graph.nodes.select("id", "kind", "file_path", F.coalesce("label", "id").alias("label"))
    known = F.array_sort(F.array_distinct(F.array_intersect("provenances", F.array(*map(F.lit, PROVENANCES)))))
    edges = graph.edges.select("source", "target", "kind", known.alias("provenances")).filter(F.size("provenances") > 0)
    return nodes, edges


def collisions(definitions: DataFrame) -> DataFrame:
    """Ids that occur in two spec directories or more; ``definitions`` has id and spec_dir."""
    return definitions.groupBy("id").agg(F.countDistinct("spec_dir").alias("n_dirs")).filter("n_dirs > 1")


def qualify(definitions: DataFrame) -> DataFrame:
    """``definitions`` with qualified_id: <spec_dir>/<id> for colliding ids, else the id."""
    hits = collisions(definitions).select("id", F.lit(True).alias("collides"))
    return definitions.join(hits, "id", "left").withColumn("qualified_id", F.when(F.col("collides"), F.concat_ws("/", "spec_dir", "id")).otherwise(F.col("id"))).drop("collides")


def suffixes(ids: DataFrame, column: str = "id") -> DataFrame:
    """Every proper suffix of each id after a slash, so that suffix matching is an equi-join."""
    parts = F.split(column, "/")
    at = F.explode(F.sequence(F.lit(2), F.size(parts)))
    return ids.filter(F.col(column).contains("/")).select(column, at.alias("__at")).select(column, F.concat_ws("/", F.slice(F.split(column, "/"), F.col("__at"), F.size(F.split(column, "/")))).alias("suffix"))


def annotation_targets(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """``refs(ref, spec_dir)`` with target and status.

    The same directory's qualified id wins; a bare id that collides without one
    is dropped; else the first id with the reference as suffix; else the
    reference as it stands.  ``ids`` has id, spec_dir and qualified_id.
    """
    own = ids.select(F.col("id").alias("ref"), "spec_dir", F.col("qualified_id").alias("own"))
    hits = collisions(ids).select(F.col("id").alias("ref"), F.lit(True).alias("collides"))
    tails = suffixes(ids.select("qualified_id").distinct(), "qualified_id").groupBy(F.col("suffix").alias("ref")).agg(F.min("qualified_id").alias("tail"))
    out = refs.join(own.distinct(), ["ref", "spec_dir"], "left").join(hits, "ref", "left").join(tails, "ref", "left")
    dropped = F.col("own").isNull() & F.coalesce("collides", F.lit(False))
    return out.select("ref", "spec_dir", F.when(~dropped, F.coalesce("own", "tail", "ref")).alias("target"), F.when(dropped, "ambiguous").otherwise("resolved").alias("status"))


def contains_edges(nodes: DataFrame) -> DataFrame:
    """Document to requirement or task of the same file."""
    docs = nodes.filter("kind = 'doc'").select(F.col("id").alias("source"), "file_path")
    inner = nodes.filter("kind in ('req', 'task')").select(F.col("id").alias("target"), "file_path")
    return docs.join(inner, "file_path").select("source", "target", F.lit("contains").alias("kind"), F.array(F.lit("structural")).alias("provenances"))


# Document stems and the stem in the same directory that each derives from.
CONVENTIONS = [("design", "requirements"), ("tasks", "design"), ("plan", "spec"), ("tasks", "plan"), ("research", "spec")]


def convention_edges(nodes: DataFrame) -> DataFrame:
    """derives_from edges between conventional document names of one directory."""
    stem = F.lower(F.regexp_extract("file_path", r"([^/]*)\.[^./]+$", 1))
    docs = nodes.filter("kind = 'doc'").select("id", F.regexp_extract("file_path", r"^(.*?)[^/]*$", 1).alias("dir"), stem.alias("stem"))
    first = docs.groupBy("dir", "stem").agg(F.min("id").alias("id"))
    pairs = nodes.sparkSession.createDataFrame(CONVENTIONS, "from_stem string, to_stem string")
    left = first.join(F.broadcast(pairs), F.col("stem") == F.col("from_stem")).select("dir", F.col("id").alias("source"), "to_stem")
    right = first.select("dir", F.col("stem").alias("to_stem"), F.col("id").alias("target"))
    return left.join(right, ["dir", "to_stem"]).select("source", "target", F.lit("derives_from").alias("kind"), F.array(F.lit("convention")).alias("provenances"))


def enclosing_symbols(tags: DataFrame, symbols: DataFrame) -> DataFrame:
    """Range join: each tag(path, line) with the smallest symbol(path, id, start, end, seq) around its line, or null.

    Symbols with a ``grp`` in common are one declaration: all of them that hold the
    line are found.
    """
    own = symbols.select("path", "id", "start", "end", "seq", F.col("grp" if "grp" in symbols.columns else "id").cast("string").alias("grp"))
    hit = tags.join(own, "path").filter(F.col("line").between(F.col("start"), F.col("end")))
    near = Window.partitionBy("path", "line").orderBy(F.col("end") - F.col("start"), "seq", "grp")
    best = hit.withColumn("__best", F.first("grp").over(near)).filter("grp = __best").select("path", "line", F.col("id").alias("symbol_id")).distinct()
    return tags.join(best, ["path", "line"], "left")


# Viewer layer of each node kind; tasks are not shown.
LAYERS = {"doc": "doc", "req": "req", "file": "code", "symbol": "code", "test": "test"}


def viewer_rows(graph: Graph, drifted: DataFrame, orphaned: DataFrame, uncovered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (no tasks) with label, layer and state (drift, orphan, uncovered or ok, the first that fits), and edges of which both ends are shown.

    The three tables have an id column each.  A node without a label is called by
    its id (requirements), its name (symbols) or its file's name.
    """
    layer = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])[F.col("kind")]
    name = F.when(F.startswith("id", F.concat(F.lit("symbol:"), "file_path", F.lit("#"))), F.substring(F.col("id"), F.length("file_path") + 9, F.length("id")))
    file = F.regexp_extract("file_path", r"([^/]*)$", 1)
    named = F.when(F.col("kind") == "req", F.col("id")).when(F.col("kind") == "symbol", F.when(name.rlike(r"[^\s\u200B-\u200D]"), name).otherwise(F.col("id"))).otherwise(F.coalesce(file, "id"))
    shown = graph.nodes.filter("kind <> 'task'").select("id", F.coalesce(F.nullif(F.col("label"), F.lit("")), named).alias("label"), layer.alias("layer"), "kind", "file_path")
    state = F.lit("ok")
    for mark, ids in (("uncovered", uncovered), ("orphan", orphaned), ("drift", drifted)):
        shown = shown.join(ids.select("id", F.lit(True).alias(mark)).distinct(), "id", "left")
        state = F.when(F.col(mark), mark).otherwise(state)
    nodes = shown.select("id", "label", "layer", "kind", state.alias("state"), "file_path")
    ids = graph.nodes.filter("kind <> 'task'").select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "semi").join(ids.withColumnRenamed("id", "target"), "target", "semi")
    return nodes, edges.select("source", "target", "kind", "provenances")


def viewer_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: shown nodes and edges, and nodes in each state but ok."""
    counts = nodes.agg(F.count("*").alias("nodes"), *[F.count_if(F.col("state") == s).alias(s) for s in ("drift", "orphan", "uncovered")])
    return counts.crossJoin(edges.agg(F.count("*").alias("edges")))  # two single rows
