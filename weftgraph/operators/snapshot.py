"""The lock: a snapshot of requirements, documents and symbols, and changes of ids in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..sources import lock as locks
from .canonical import union_dependencies

# The hash of unreadable files, and the warning of an incomplete build.
UNREADABLE = "unreadable"
EXHAUSTED = "system-resource-exhausted"


def build_lock(graph: Graph, now: str, previous: DataFrame | None = None) -> DataFrame:
    """One entry per requirement, document (readable) and symbol.

    Lists are sorted and null where empty; dependencies lead to existing nodes
    only.  An entry equal to the previous one keeps its time.
    """

    def listed(edges: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return edges.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(value)).alias(name))

    deps = graph.edges_of("depends_on", "derives_from").join(graph.nodes.select(F.col("id").alias("target")), "target", "semi")
    joined = union_dependencies(deps, "source", "target").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("target").alias("id"), "provenances"))).alias("depends_on"))
    named = graph.kinds("req", "doc").filter(F.col("content_hash") != UNREADABLE)
    full = (
        named.select("id", F.col("file_path").alias("spec_file"), "content_hash")
        .join(listed(graph.claims("implements"), "target", "source", "impl"), "id", "left")
        .join(listed(graph.claims("verifies"), "target", "source", "tests"), "id", "left")
        .join(listed(graph.edges_of("exercises"), "source", "target", "exercises"), "id", "left")
        .join(joined, "id", "left")
    )
    symbols = graph.kinds("symbol").select("id", "content_hash")
    out = full.unionByName(symbols, allowMissingColumns=True)
    if previous is None:
        return out.withColumn("last_reconciled", F.lit(now))
    names = [c for c in out.columns if c != "id"]
    old = previous.select("id", F.struct(*names).alias("old"), F.col("last_reconciled").alias("old_time"))
    same = F.struct(*names).eqNullSafe(F.col("old"))
    return out.join(old, "id", "left").select("id", *names, F.when(same, F.col("old_time")).otherwise(F.lit(now)).alias("last_reconciled"))


def reconcile(graph: Graph, warnings: DataFrame, folder: str, now: str, force: bool = False) -> int:
    """Write the lock of ``graph`` as the folder's next version, on top of the last one; returns its number.

    Entries that did not change keep their time.  A graph whose build ran out of
    resources is refused, as it may lack whole trees; the folder is not touched
    then, nor if a later schema wrote it, unless ``force``.
    """
    if not warnings.filter(F.col("type") == EXHAUSTED).isEmpty():
        raise ValueError("the build ran out of resources, so its graph may be incomplete: the lock is left as it is")
    spark = graph.nodes.sparkSession
    held = bool(locks.versions(spark, folder))
    return locks.write_lock(build_lock(graph, now, locks.read_lock(spark, folder) if held else None), folder, force)


def rename_key(lock: DataFrame, old: str, new: str) -> DataFrame:
    """``old`` becomes ``new`` as key and in dependencies."""
    swap = lambda x: F.when(x == old, new).otherwise(x)
    deps = F.transform("depends_on", lambda d: F.struct(swap(d["id"]).alias("id"), d["provenances"].alias("provenances")))
    return lock.withColumns({"id": swap(F.col("id")), "depends_on": _united(deps)})


def split_key(lock: DataFrame, old: str, new: list[str]) -> DataFrame:
    """``old`` becomes several keys, each with an empty hash; dependencies on it fan out."""
    fan = F.flatten(
        F.transform(
            "depends_on",
            lambda d: F.when(d["id"] == old, F.array(*[F.struct(F.lit(n).alias("id"), d["provenances"].alias("provenances")) for n in new])).otherwise(F.array(F.struct(d["id"].alias("id"), d["provenances"].alias("provenances")))),
        )
    )
    ids = F.when(F.col("id") == old, F.array(*map(F.lit, new))).otherwise(F.array("id"))
    out = lock.withColumn("depends_on", _united(fan)).withColumn("__new", ids)
    hashed = F.when(F.col("id") == old, F.lit("")).otherwise(F.col("content_hash"))
    return out.withColumn("content_hash", hashed).withColumn("id", F.explode("__new")).drop("__new")


def merge_keys(lock: DataFrame, old: list[str], new: str) -> DataFrame:
    """Several keys become one: lists are united, other fields are the first that is set in the order of ``old``, and self references go."""
    rank = F.array_position(F.array(*map(F.lit, old)), F.col("id"))
    swap = lambda x: F.when(x.isin(*old), new).otherwise(x)
    deps = F.transform("depends_on", lambda d: F.struct(swap(d["id"]).alias("id"), d["provenances"].alias("provenances")))
    moved = lock.withColumn("__rank", rank).withColumn("depends_on", deps)
    keep = moved.filter("__rank = 0").drop("__rank").withColumn("depends_on", _united(F.col("depends_on")))
    into = moved.filter("__rank > 0")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__rank"))).alias(c)
    united = lambda c: F.nullif(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), F.array().cast("array<string>")).alias(c)
    one = into.groupBy().agg(
        F.count("*").alias("__n"), first("spec_file"), first("content_hash"), united("impl"), united("tests"), united("exercises"), F.flatten(F.collect_list("depends_on")).alias("depends_on"), first("last_reconciled")
    )
    one = one.filter("__n > 0").withColumn("depends_on", _united(F.filter("depends_on", lambda d: d["id"] != new))).withColumn("id", F.lit(new)).drop("__n")
    return keep.unionByName(one)


def _united(deps: Column) -> Column:
    """Dependencies with one entry per id, provenances united, in order; null where none."""
    ids = F.array_sort(F.array_distinct(F.transform(deps, lambda d: d["id"])))
    merged = F.transform(
        ids,
        lambda i: F.struct(
            i.alias("id"), F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(deps, lambda d: d["id"] == i), lambda d: d["provenances"])))).alias("provenances")
        ),
    )
    return F.when(F.size(merged) > 0, merged)


def entries_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids whose entries agree in all but their time."""
    names = [c for c in a.columns if c not in ("id", "last_reconciled")]
    left, right = a.select("id", F.struct(*names).alias("x")), b.select("id", F.struct(*names).alias("y"))
    return left.join(right, "id").filter(F.col("x").eqNullSafe(F.col("y"))).select("id")
