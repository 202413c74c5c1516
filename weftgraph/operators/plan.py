"""Plan coverage: the files that a plan names, the requirements these touch, and those it does not mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import index_mentions, plain_path
from ..graph import Graph, large, stored
from . import traverse

# The input format of section headers, headings, checklist items, list entries, the note behind an entry,
# tasks, paths with a symbol and loose paths.
HEADER = r"^Files:[ \t]*(.*)$"
TITLE = r"^#+\s"
CHECKBOX = r"^\s*[-*]\s+\[[ xX]\]"
BULLET = r"^\s*[-*]\s+(.+?)\s*$"
NOTE = r"\s*\([^)]*\)\s*$"
TASK = r"^(?:#+|\s*[-*]\s+\[[ xX]\])\s+(T?\d+(?:\.\d+)*)\b"
PATH_SYMBOL = r"^([^:\s]+\.\w+):([^\s,()]+)$"
LOOSE = r"(?<![\w./-])[\w./-]+\.\w+(?![\w./-])"


def _lines(plans: DataFrame) -> DataFrame:
    """plan, n, line and the Files: header (its line number) in whose scope the line lies, else null.

    A scope ends at a heading, a checklist item or the second of two blank lines;
    a header inside a scope is a line like others.
    """
    rows = plans.select("plan", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("plan", (F.col("i") + 1).alias("n"), "line")
    order = Window.partitionBy("plan").orderBy("n")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    blank = F.trim(F.regexp_replace("line", r"\s", "")) == ""
    twice = blank & F.coalesce(F.lag(blank).over(order), F.lit(False))
    event = F.when(F.col("line").rlike(HEADER), F.col("n")).when(F.col("line").rlike(TITLE) | F.col("line").rlike(CHECKBOX) | twice, F.lit(0))
    marked = rows.withColumn("event", event).withColumn("before", F.last("event", True).over(above))
    marked = marked.withColumn("event", F.when(~((F.col("event") > 0) & (F.coalesce("before", F.lit(0)) > 0)), F.col("event")))
    return marked.withColumn("scope", F.nullif(F.last("event", True).over(order), F.lit(0))).drop("event", "before")


def section_entries(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (plan, path, symbol, line) of ``Files:`` sections of ``plans(plan, text)``, and paths that are absolute or leave the root."""
    lines = _lines(plans).filter("scope is not null")
    tail = F.regexp_replace(F.trim(F.regexp_extract("line", HEADER, 1)), r"[.;]\s*$", "")
    pieces = F.when(F.col("n") == F.col("scope"), F.split(tail, ",")).otherwise(F.array(F.regexp_extract("line", BULLET, 1)))
    raw = F.explode(F.transform(pieces, lambda p: F.trim(F.regexp_replace(F.trim(p), NOTE, ""))))
    found = lines.select("plan", F.col("n").alias("line"), raw.alias("raw")).filter("raw <> ''")
    symbol = F.nullif(F.regexp_extract("raw", PATH_SYMBOL, 2), F.lit(""))
    named = found.withColumn("symbol", symbol).withColumn("given", F.when(F.col("symbol").isNotNull(), F.regexp_extract("raw", PATH_SYMBOL, 1)).otherwise(F.col("raw")))
    named = named.withColumn("path", plain_path(F.col("given")))
    entries = named.filter("path is not null").groupBy("plan", "path", "symbol").agg(F.min("line").alias("line"))
    return entries, named.filter("path is null").select("plan", F.col("given").alias("path"), "line")


def loose_entries(plans: DataFrame, known: DataFrame) -> DataFrame:
    """Path-shaped tokens anywhere in the text that are ``known(path)``: the fallback of plans without section entries."""
    rows = plans.select("plan", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("plan", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("line", F.lit(LOOSE), F.lit(0))).alias("path"))
    first = rows.groupBy("plan", "path").agg(F.min("line").alias("line"))
    return first.join(known.select("path").distinct(), "path", "semi").select("plan", "path", F.lit(None).cast("string").alias("symbol"), "line")


def entries(plans: DataFrame, graph: Graph) -> DataFrame:
    """Entries of each plan: of its sections, else of its text."""
    own, _ = section_entries(plans)
    bare = plans.join(own.select("plan").distinct(), "plan", "anti")
    known = graph.kinds("file", "test").select(F.col("file_path").alias("path"))
    return own.select("plan", "path", "symbol", "line").unionByName(loose_entries(bare, known))


def task_blocks(plans: DataFrame) -> DataFrame:
    """plan, task_id, line and has_files of task headings and checklist items; a block ends at the next task or heading."""
    lines = _lines(plans)
    task = F.regexp_extract("line", TASK, 1)
    stop = (F.col("task") != "") | F.col("line").rlike(TITLE)
    order = Window.partitionBy("plan").orderBy("n")
    held = lines.withColumn("task", task).withColumn("own", F.last(F.when(stop, F.struct("n", "task")), True).over(order)).filter("own.task <> ''")
    return held.groupBy("plan", F.col("own.task").alias("task_id"), F.col("own.n").alias("line")).agg(F.max(F.col("line").rlike(HEADER) & (F.col("n") > F.col("own.n"))).alias("has_files"))


def unresolved(found: DataFrame, graph: Graph) -> DataFrame:
    """Entries whose path is no node's, or whose symbol is unknown in a known path; one finding each, the path's first."""
    paths = graph.kinds("file", "test").select(F.col("file_path").alias("path")).distinct()
    no_path = found.join(paths, "path", "anti").select("plan", F.lit("unresolvedFilePath").alias("kind"), "path", F.lit(None).cast("string").alias("symbol"), "line")
    symbols = graph.kinds("symbol").select("id")
    named = found.filter("symbol is not null").join(paths, "path", "semi").withColumn("id", F.concat(F.lit("symbol:"), "path", F.lit("#"), "symbol"))
    return no_path.unionByName(named.join(symbols, "id", "anti").select("plan", F.lit("unresolvedSymbol").alias("kind"), "path", "symbol", "line"))


def touched(found: DataFrame, graph: Graph) -> DataFrame:
    """plan, path, symbol and req_id: the requirements that each entry itself implements (a path entry's symbols count)."""
    named = found.filter("symbol is not null").select("plan", "path", "symbol", F.concat(F.lit("symbol:"), "path", F.lit("#"), "symbol").alias("source"))
    whole = found.filter("symbol is null")
    as_file = whole.select("plan", "path", "symbol", F.concat(F.lit("file:"), "path").alias("source"))
    inside = whole.join(graph.kinds("symbol").select(F.col("file_path").alias("path"), F.col("id").alias("source")), "path").select("plan", "path", "symbol", "source")
    starts = named.unionByName(as_file).unionByName(inside)
    claims = graph.edges_of("implements").select("source", F.col("target").alias("req_id"))
    reqs = graph.kinds("req").select(F.col("id").alias("req_id"))
    return starts.join(claims, "source").join(reqs, "req_id", "semi").select("plan", "path", "symbol", "req_id").distinct()


def with_mentions(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``rows(plan, req_id)`` with mentioned: whether the plan's text names the requirement."""
    rows = stored(rows)
    said = index_mentions(plans, rows, "plan", "req_id").withColumn("mentioned", F.lit(True))
    return rows.join(said, ["plan", "req_id"], "left").withColumn("mentioned", F.coalesce("mentioned", F.lit(False)))


def plan_coverage(plans: DataFrame, graph: Graph, ignored: DataFrame | None = None) -> DataFrame:
    """plan, req_id, mentioned and locations: every requirement that a plan's files implement, and whether its text mentions it.

    ``ignored(req_id)`` are left out unless mentioned.  Texts are cut into runs of
    words once and met by the ids there; they are in no other join.
    """
    hits = touched(entries(plans, graph), graph)
    location = F.concat("path", F.coalesce(F.concat(F.lit(":"), "symbol"), F.lit("")))
    per = hits.groupBy("plan", "req_id").agg(F.array_sort(F.collect_set(location)).alias("locations"))
    out = with_mentions(per, plans)
    if ignored is not None:
        out = out.join(ignored.select("req_id", F.lit(True).alias("skip")), "req_id", "left").filter("skip is null or mentioned").drop("skip")
    return out.select("plan", "req_id", "mentioned", "locations")


def entry_impact(found: DataFrame, graph: Graph, max_depth: int | None = None) -> DataFrame:
    """plan, path, symbol, impact and origin (requirements, in order) of every entry that leads to a start.

    All entries of all plans are walked together, each from its own starts;
    ``origin`` are the requirements that the entry itself, or what it imports,
    implements.
    """
    spark = graph.nodes.sparkSession
    places = found.select("path", "symbol").distinct()
    label = F.concat("path", F.coalesce(F.concat(F.lit(":"), "symbol"), F.lit("")))
    places = stored(places.withColumn("origin", label))
    starts = stored(traverse.start_ids_each(graph, places))
    reqs = graph.kinds("req").select("id")
    impact = whole_impact(graph, starts, reqs) if max_depth is None else traverse.reach_each(graph, starts, max_depth).join(reqs, "id", "semi").groupBy("origin").agg(F.array_sort(F.collect_set("id")).alias("impact"))
    # What an entry is: its symbol, or its file and the symbols in it; and the symbols that these import.
    named = places.filter("symbol is not null").select("origin", F.concat(F.lit("symbol:"), "path", F.lit("#"), "symbol").alias("id"))
    closed = traverse.import_closure_each(graph, named.unionByName(starts.join(named.select("origin"), "origin", "anti")))
    claims = graph.edges_of("implements").select(F.col("source").alias("id"), F.col("target").alias("req_id"))
    own = closed.join(claims, "id").join(reqs.withColumnRenamed("id", "req_id"), "req_id", "semi").groupBy("origin").agg(F.array_sort(F.collect_set("req_id")).alias("origin_reqs"))
    none = F.array().cast("array<string>")
    out = places.join(starts.select("origin").distinct(), "origin", "semi").join(impact, "origin", "left").join(own, "origin", "left")
    out = out.select("path", "symbol", F.coalesce("impact", none).alias("impact"), F.coalesce("origin_reqs", none).alias("origin"))
    return found.select("plan", "path", "symbol").distinct().join(out, ["path"]).filter(found["symbol"].eqNullSafe(out["symbol"])).select("plan", "path", out["symbol"], "impact", "origin")


def whole_impact(graph: Graph, starts: DataFrame, reqs: DataFrame) -> DataFrame:
    """origin and impact, in order, over any number of steps; what all origins of a hub reach is listed once and handed to each of them."""
    own, taken, held = traverse.shared_reach(graph, starts)
    listed = lambda df: df.agg(F.array_sort(F.collect_set("id")).alias("ids"))
    width = int(graph.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A copy of a hub's list for each part of its origins: it passes by the driver.
    copies = stored(listed(held.join(reqs, "id", "semi").groupBy("hub"))).select("hub", F.col("ids").alias("shared"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("part"))
    alone = listed(own.join(reqs, "id", "semi").groupBy("origin")).withColumnRenamed("ids", "own")
    told = alone.join(taken, "origin", "full").withColumn("part", F.pmod(F.xxhash64("origin"), F.lit(width)).cast("int"))
    none = F.array().cast("array<string>")
    ids = F.array_sort(F.array_union(F.coalesce("shared", none), F.coalesce("own", none)))
    return told.join(large(copies), ["hub", "part"], "left").select("origin", F.when(F.col("own").isNull(), F.col("shared")).otherwise(ids).alias("impact"))


def implicit_groups(plans: DataFrame, impacts: DataFrame, reqs: DataFrame, ignored: DataFrame) -> DataFrame:
    """The groups by location of ``implicit_impacts``, told from whole lists: no row for each plan and requirement is made.  ``reqs(id)`` may be mentioned."""
    listed = lambda df, name: df.agg(F.collect_set("req_id").alias(name))
    said = listed(index_mentions(plans, reqs.select(F.col("id").alias("req_id")), "plan", "req_id").groupBy("plan"), "said")
    skip = listed(ignored, "skip")  # what a user lists
    rows = impacts.join(said, "plan", "left").join(F.broadcast(skip), F.lit(True))
    left = F.array_except(F.array_except("impact", "skip"), F.coalesce("said", F.array().cast("array<string>")))
    rows = rows.select("plan", "path", "symbol", left.alias("impact"), F.array_except("origin", "skip").alias("origin")).filter(F.size("impact") > 0)
    return rows.select("*", F.array_except("impact", "origin").alias("drift"))


def implicit_impacts(plans: DataFrame, impacts: DataFrame, ignored: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups by location, groups by requirement, and one row of counts for each plan.

    A location's group has the requirements that it reaches and that the plan
    neither mentions nor ignores, those that it implements, and the difference as
    drift; empty groups go.
    """
    affected = with_mentions(impacts.select("plan", F.explode("impact").alias("req_id")).distinct(), plans)
    if ignored is None:
        affected = affected.withColumn("ignored", F.lit(False))
    else:
        affected = affected.join(ignored.select("req_id", F.lit(True).alias("ignored")).distinct(), "req_id", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
    affected = stored(affected)
    seen = affected.filter("not mentioned and not ignored").select("plan", "req_id")
    shown = impacts.select("plan", "path", "symbol", "origin", F.explode("impact").alias("req_id")).join(seen, ["plan", "req_id"])
    groups = shown.groupBy("plan", "path", "symbol", "origin").agg(F.array_sort(F.collect_set("req_id")).alias("impact"))
    if ignored is not None:
        skip = ignored.agg(F.collect_set("req_id").alias("skip"))  # what a user lists
        groups = groups.join(F.broadcast(skip), F.lit(True)).withColumn("origin", F.array_except("origin", "skip")).drop("skip")
    groups = groups.withColumn("drift", F.array_except("impact", "origin")).select("plan", "path", "symbol", "impact", "origin", "drift")
    location = F.concat("path", F.coalesce(F.concat(F.lit(":"), "symbol"), F.lit("")))
    by_req = groups.select("plan", F.explode("impact").alias("req_id"), location.alias("location")).groupBy("plan", "req_id").agg(F.array_sort(F.collect_set("location")).alias("locations"))
    counts = affected.groupBy("plan").agg(
        F.count("*").alias("total"), F.count_if(F.col("mentioned")).alias("mentioned"), F.count_if(~F.col("mentioned") & ~F.col("ignored")).alias("implicit"), F.count_if(F.col("ignored") & ~F.col("mentioned")).alias("ignored")
    )
    return groups, by_req, counts


def diagnostics(plans: DataFrame, found: DataFrame, analysed: DataFrame, graph: Graph) -> DataFrame:
    """plan, kind, detail and line: tasks without a file list, unknown paths and symbols, and plans of which nothing was analysed."""
    bare = task_blocks(plans).filter("not has_files").select("plan", F.lit("missingFilesSection").alias("kind"), F.col("task_id").alias("detail"), F.col("line").cast("long").alias("line"))
    lost = unresolved(found, graph).select("plan", "kind", F.concat_ws(":", "path", "symbol").alias("detail"), F.col("line").cast("long").alias("line"))
    empty = plans.select("plan").join(analysed.select("plan").distinct(), "plan", "anti").select("plan", F.lit("emptyExtraction").alias("kind"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("long").alias("line"))
    return bare.unionByName(lost).unionByName(empty)
