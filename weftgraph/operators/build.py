"""From files to a graph: every extraction, id resolution, repair and warning in one pass order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import TOKEN
from ..graph import Graph, short_hash, small_broadcasts, stored
from ..sources.fragments import Fragments
from ..sources.text import code_files
from . import extract
from .blocks import blocks
from .canonical import annotation_targets, collisions, contains_edges, convention_edges, dedup_edges, enclosing_symbols, last_nodes, suffixes
from .declarations import declarations
from .evidence import evidence_edges
from .resolve import project_options
from .stars import providers


@dataclass(frozen=True)
class Layout:
    """Where specifications and code lie, and what to read of them.

    ``token`` is the id grammar of list items, annotations and tags; ``ignored``
    are id prefixes that make no node and no claim; ``grain`` is symbol or file.
    ``heading`` captures the number or id of headings that are requirements,
    ``conventions`` say how tasks are written.
    """

    spec_dirs: tuple[str, ...] = ("specs",)
    include: tuple[str, ...] = ("src/**/*.ts",)
    tests: tuple[str, ...] = ("**/*.test.ts",)
    ignored: tuple[str, ...] = ()
    grain: str = "symbol"
    token: str = TOKEN
    key: str = "graph"
    heading: str = extract.HEADING
    conventions: tuple[extract.Convention, ...] = extract.CONVENTIONS


# Fields of the front matter that a document's node carries.
METADATA = ("title", "status", "priority", "owner")
# Prefixes of ids that the build makes itself, and how many paths a warning names.
RESERVED = ("doc:", "file:", "test:", "symbol:")
SAMPLES = 5


def spec_dir_of(path: Column, spec_dirs: tuple[str, ...]) -> Column:
    """The directory below a specification root that a file lies in; for a file right in a root, its own directory's name."""
    own = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    below = F.lit(None).cast("string")
    for root in spec_dirs:
        below = F.coalesce(below, F.nullif(F.regexp_extract(path, rf"^{re.escape(root)}/([^/]+)/", 1), F.lit("")))
    return F.coalesce(below, own)


def is_ignored(node_id: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether the last part of an id is one of the prefixes, a hyphen and a number."""
    if not prefixes:
        return F.lit(False)
    return node_id.rlike(rf"(?:^|/)(?:{'|'.join(map(re.escape, prefixes))})-\d+$")


# The types of warnings, wherever they are named below, are fixed values of the data model.
def warning(df: DataFrame, kind: str | Column, id_: Column, file: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(kind.alias("type"), id_.alias("id"), file.alias("file")).distinct()


def edge_rows(df: DataFrame, source: Column, target: Column, kind: Column | str, provenance: str, space: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    space = F.lit(None).cast("string") if space is None else space
    return df.select(source.alias("source"), target.alias("target"), kind.alias("kind"), F.array(F.lit(provenance)).alias("provenances"), space.alias("target_space"))


def expand_stars(symbols: DataFrame, stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and import edges of names that ``export *`` hands on: ``symbols(path, name)``, ``stars(path, target)``."""
    single = stored(providers(symbols, stars))
    node, origin = (F.concat(F.lit("symbol:"), c, F.lit("#"), "name") for c in ("path", "target"))
    nodes = single.select(node.alias("id"), F.lit("symbol").alias("kind"), F.col("path").alias("file_path"), F.col("name").alias("label"), short_hash(F.concat_ws("\0", "target", "name", "name")).alias("content_hash"))
    return nodes, edge_rows(single, node, origin, "imports", "ts-import")


def repair_imports(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Import edges to symbols that are no node go to the owning file if that is one; both cases are warned of."""
    owner = F.concat(F.lit("file:"), F.regexp_extract("target", r"^symbol:(.*)#[^#]*$", 1))
    lost = (F.col("kind") == "imports") & F.col("target").startswith("symbol:")
    known = ids.select(F.col("id").alias("target"), F.lit(True).alias("is_node"))
    files = ids.select(F.col("id").alias("owner"), F.lit(True).alias("is_file"))
    # Read by the edges and by the warnings, so stored: imports are made once.
    marked = stored(edges.withColumn("owner", owner).join(known, "target", "left").join(files, "owner", "left"))
    bad = lost & F.col("is_node").isNull()
    repaired = marked.withColumn("target", F.when(bad & F.col("is_file"), F.col("owner")).otherwise(F.col("target"))).select(edges.columns)
    source = F.regexp_replace(F.regexp_replace("source", r"^(?:file|symbol):", ""), r"#[^#]*$", "")
    told = marked.filter(bad).select(F.when(F.col("is_file"), "phantom-import-repaired").otherwise("dangling-import").alias("type"), F.col("target").alias("id"), source.alias("file"))
    return repaired, told.distinct()


def build(files: DataFrame, layout: Layout = Layout(), kept: Fragments | None = None, evidence: DataFrame | None = None) -> tuple[Graph, DataFrame]:  # noqa: B008
    """The graph of ``files(path, text)`` and its warnings (type, id, file).

    Specifications give documents, requirements and tasks, annotations, relations
    of the front matter and links; code gives files, tests, symbols, tags and
    imports.  Ids that two specification directories define are qualified by
    theirs.  With ``kept`` only files that are not in that folder yet are parsed,
    and what is read of them is kept there.  ``evidence(req_id, node_id)`` is
    merged in last: it confirms claims and else makes edges of its own.  Documents
    carry title, status, priority and owner as metadata.  The order is: definitions, ids, relations, code, star exports,
    repair of imports, structure and conventions, links, canonical form.
    """
    with small_broadcasts(files.sparkSession):
        return _build(files, layout, kept, evidence)


def _build(files: DataFrame, layout: Layout, kept: Fragments | None, evidence: DataFrame | None) -> tuple[Graph, DataFrame]:
    in_spec = F.lit(False)
    for root in layout.spec_dirs:
        in_spec = in_spec | F.col("path").startswith(f"{root}/")
    specs = stored(files.filter(in_spec & F.col("path").rlike(r"(?i)\.md$")))
    code = stored(code_files(files, list(layout.include), list(layout.tests)))
    warnings = []

    # Definitions and their ids.
    place = lambda df: df.withColumn("spec_dir", spec_dir_of(F.col("file_path"), layout.spec_dirs))
    keep = lambda df, c: df.filter(~is_ignored(F.col(c), layout.ignored))
    parts = kept.read(specs, "blocks", lambda f: blocks(f, layout.heading), layout.heading)[0] if kept else stored(blocks(specs, layout.heading))
    reqs = place(keep(extract.requirements(parts, layout.token, layout.heading), "id"))
    task_nodes, task_edges = extract.tasks(parts, layout.conventions, layout.heading)
    tasks = place(keep(task_nodes, "id"))
    defined = stored(reqs.select("id", "file_path", F.col("line").cast("long").alias("line"), "label", "content_hash", "spec_dir", F.lit("req").alias("kind")).unionByName(
        tasks.select("id", "file_path", F.col("line").cast("long").alias("line"), F.lit(None).cast("string").alias("label"), "content_hash", "spec_dir", F.lit("task").alias("kind"))
    ))
    double = stored(collisions(defined).select("id"))
    qualified = F.when(F.col("collides"), F.concat_ws("/", "spec_dir", "id")).otherwise(F.col("id"))
    defined = stored(defined.join(double.withColumn("collides", F.lit(True)), "id", "left").withColumn("qualified_id", qualified).drop("collides"))
    ids = defined.select("id", "spec_dir", "qualified_id").distinct()

    front = stored(extract.front_matter(specs, layout.key))
    rest = F.regexp_replace("path", rf"^(?:{'|'.join(map(re.escape, layout.spec_dirs))})/", "")
    stated_fields = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in METADATA]), lambda e: e["value"].isNotNull())
    metadata = F.when(F.size(stated_fields) > 0, F.map_from_entries(stated_fields))
    hashed = parts.filter("kind = 'document'").select("path", F.col("text").alias("doc_hash"))
    docs = specs.join(front, "path", "left").join(hashed, "path", "left").select(
        F.coalesce("node_id", F.concat(F.lit("doc:"), rest)).alias("id"), F.lit("doc").alias("kind"), F.col("path").alias("file_path"), F.col("title").alias("label"), F.coalesce("doc_hash", short_hash(F.col("text"))).alias("content_hash"), metadata.alias("metadata")
    )
    docs = stored(docs)
    spec_nodes = defined.select(F.col("qualified_id").alias("id"), "kind", "file_path", "label", "content_hash", F.col("line"))

    # Relations that specifications state.
    named = ids.select(F.col("id").alias("source"), "spec_dir", F.col("qualified_id").alias("own"))
    noted = stored(place(extract.annotations(parts, layout.token, layout.heading)).join(named, ["source", "spec_dir"]))
    warnings.append(warning(noted.filter("status = 'invalid'"), "invalid-annotation-id", F.col("target"), F.col("file_path")))
    warnings.append(warning(noted.filter("status = 'empty'"), "empty-annotation", F.col("kind"), F.col("file_path")))
    valid = noted.filter("status = 'valid'").withColumnRenamed("target", "ref")
    aims = annotation_targets(valid.select("ref", "spec_dir").distinct(), ids).withColumnRenamed("status", "found")
    aimed = stored(valid.join(aims, ["ref", "spec_dir"]))
    warnings.append(warning(aimed.filter("found = 'ambiguous'"), "ambiguous-id", F.col("ref"), F.col("file_path")))
    warnings.append(warning(aimed.filter("own = target"), "self-reference-annotation", F.col("own"), F.col("file_path")))
    annotated = edge_rows(aimed.filter("found = 'resolved' and own <> target"), F.col("own"), F.col("target"), F.col("kind"), "annotation")

    doc_at = docs.select(F.col("file_path").alias("path"), F.col("id").alias("source"))
    stated = front.join(doc_at, "path").select("source", F.col("path").alias("file_path"), F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("targets")) for k in ("derives_from", "depends_on")])))
    stated = stated.select("source", "file_path", "kind", F.explode("targets").alias("ref"))
    tagged = place(task_edges).join(named, ["source", "spec_dir"]).select(F.col("own").alias("source"), "file_path", "kind", F.col("target").alias("ref"), "target_space").filter(~is_ignored(F.col("ref"), layout.ignored))
    # A reference to a colliding id means the one qualified id that ends in it; if there are more, it stays and is warned of.
    tails = suffixes(ids.select("qualified_id").distinct(), "qualified_id").groupBy(F.col("suffix").alias("ref")).agg(F.min("qualified_id").alias("tail"), F.countDistinct("qualified_id").alias("n"))
    tails = tails.join(double.select(F.col("id").alias("ref")), "ref", "semi")
    both = stated.withColumns({"target_space": F.lit(None).cast("string"), "by": F.lit("frontmatter")}).unionByName(tagged.withColumn("by", F.lit("task-tag"))).join(tails, "ref", "left")
    both = stored(both.withColumn("target", F.when(F.col("n") == 1, F.col("tail")).otherwise(F.col("ref"))))
    warnings.append(warning(both.filter("n > 1"), "ambiguous-id", F.col("ref"), F.col("file_path")))
    related = both.select("source", "target", "kind", F.array("by").alias("provenances"), "target_space")
    warnings.append(warning(extract.unknown_relations(specs, layout.key), "invalid-relation", F.col("key"), F.col("path")))

    # Code: files, symbols, tags and imports.
    bare = F.regexp_replace("text", "^\ufeff", "")
    file_id = F.concat(F.lit("file:"), "path")
    code_nodes = code.select(file_id.alias("id"), F.when(F.col("is_test"), "test").otherwise("file").alias("kind"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("label"), short_hash(bare).alias("content_hash"))
    declared = kept.read(code.select("path", "text"), "declarations", declarations)[0] if kept else stored(declarations(code.select("path", "text")))
    # What specifiers may stand for: the files of both pools, manifests and other JSON, as far as the project's configuration allows.
    known = stored(code.select("path", "text").unionByName(files.filter(F.col("path").endswith(".json")).select("path", "text")))
    how = project_options(known), declared.filter("kind = 'file' and name = 'module'").select("path")
    tests = code.filter("is_test").select("path")
    own = declared.join(tests, "path", "anti")
    links = stored(extract.specifiers(declared, known, *how))
    inner = links.join(tests, "path", "anti")
    # Installed packages are no sources: some of their paths are told, of each pool one at least.
    packaged = code.filter(F.array_contains(F.split("path", "/"), "node_modules")).select("path", "is_test")
    samples = packaged.groupBy("is_test").agg(F.min("path").alias("path")).select("path", F.lit(0).alias("rank")).unionByName(packaged.select("path", F.lit(1).alias("rank")).orderBy("path").limit(SAMPLES))
    samples = samples.groupBy("path").agg(F.min("rank").alias("rank")).orderBy("rank", "path").limit(SAMPLES)
    warnings.append(warning(samples, "node-modules-in-scan", F.lit("node_modules"), F.col("path")))
    reserved = F.col("id").rlike(rf"^(?:{'|'.join(RESERVED)})") | (F.col("id") == "_meta")
    warnings.append(warning(defined.filter(reserved), "reserved-prefix", F.col("id"), F.col("file_path")))
    warnings.append(warning(docs.filter("id = '_meta'"), "reserved-prefix", F.col("id"), F.col("file_path")))
    symbols = stored(extract.symbols(own)) if layout.grain == "symbol" else None
    tags = extract.implementation_tags(own, layout.token)
    if symbols is not None:
        near = enclosing_symbols(tags.select("path", "line").distinct(), symbols)
        tags = tags.join(near, ["path", "line"], "left").withColumn("source", F.coalesce("symbol_id", file_id))
    else:
        tags = tags.withColumn("source", file_id)
    claims = edge_rows(tags, F.col("source"), F.col("req_id"), "implements", "code-tag").unionByName(
        edge_rows(extract.test_tags(code.filter("is_test"), layout.token), file_id, F.col("req_id"), "verifies", "code-tag")
    )
    claims = claims.filter(~is_ignored(F.col("target"), layout.ignored)).join(double.select(F.col("id").alias("target"), F.lit(True).alias("collides")), "target", "left")
    claims = stored(claims.join(ids.select(F.col("qualified_id").alias("target"), F.lit(True).alias("known")).distinct(), "target", "left"))
    unsure = F.col("collides") | (F.col("target").contains("/") & F.col("known").isNull())
    warnings.append(warning(claims.filter(unsure), "ambiguous-id", F.col("target"), F.lit(None).cast("string")))
    claims = claims.filter("collides is null").select(related.columns)

    node_parts = [code_nodes]
    if symbols is not None:
        seen = Window.partitionBy("id").orderBy("seq")
        first = symbols.withColumn("r", F.row_number().over(seen)).filter("r = 1")
        node_parts.append(first.select("id", F.lit("symbol").alias("kind"), F.col("path").alias("file_path"), F.col("name").alias("label"), "content_hash"))
        # Tests are no symbols' home: what they import are files.
        taken = extract.named_imports(known, inner).union(extract.imports(known, links.join(tests, "path", "semi")))
        moved = edge_rows(taken, F.col("source"), F.col("target"), "imports", "ts-import")
        handed = stored(extract.reexports(known, inner))
        node_parts.append(handed.join(symbols.select("id"), "id", "anti").select("id", F.lit("symbol").alias("kind"), F.col("path").alias("file_path"), F.col("name").alias("label"), "content_hash"))
        handed_on, led_on = expand_stars(symbols.select("path", "name").union(handed.select("path", "name")), extract.star_exports(known, inner))
        node_parts.append(handed_on)
        moved = moved.unionByName(led_on)
        members = edge_rows(symbols.filter("owner is not null"), F.col("owner"), F.col("id"), "contains", "structural")
    else:
        moved = edge_rows(extract.imports(known, links), F.col("source"), F.col("target"), "imports", "ts-import")
        members = moved.limit(0)

    every = docs.withColumn("line", F.lit(0).cast("long")).unionByName(spec_nodes, allowMissingColumns=True)
    for part in node_parts:
        every = every.unionByName(part.withColumn("line", F.lit(0).cast("long")), allowMissingColumns=True)
    every = stored(every.withColumn("seq", F.struct("file_path", "line")).drop("line"))
    nodes, repeated = last_nodes(every)
    nodes = stored(nodes)
    warnings.append(repeated.select("type", "id", F.explode("files").alias("file")))
    moved, told = repair_imports(moved, nodes.select("id"))
    warnings.append(told)
    stray = extract.unresolved_specifiers(declared, links)
    warnings.append(warning(stray, F.when(F.col("kind") == "import", "unresolved-import").otherwise("unresolved-reexport"), F.col("spec"), F.col("path")))

    # Structure, conventions and links.
    structure = contains_edges(nodes).unionByName(convention_edges(nodes)).withColumn("target_space", F.lit(None).cast("string"))
    plain = annotated.unionByName(related).unionByName(claims).unionByName(moved).unionByName(members).unionByName(structure)
    plain = stored(plain)
    held = nodes.select(F.col("id").alias("target"), F.lit(True).alias("known"))
    at = nodes.select(F.col("id").alias("source"), F.col("kind").alias("source_kind"), F.col("file_path").alias("file"))
    lost = plain.join(held, "target", "left").filter("known is null").join(at, "source", "left")
    warnings.append(warning(lost.filter(F.array_contains("provenances", "annotation")), "orphan-edge", F.col("target"), F.col("file")))
    warnings.append(warning(lost.filter("source_kind = 'doc' and kind in ('derives_from', 'depends_on')"), "orphan-doc", F.col("target"), F.col("file")))
    links = stored(extract.inline_links(specs).join(doc_at.withColumnRenamed("path", "file_path"), "file_path").withColumnRenamed("target", "path"))
    led = links.join(doc_at.withColumnRenamed("source", "target"), "path", "left")
    stated_pairs = plain.filter("kind in ('derives_from', 'depends_on')").select("source", "target").distinct()
    linked = edge_rows(led.filter("target is not null").join(stated_pairs, ["source", "target"], "anti"), F.col("source"), F.col("target"), "depends_on", "inline-link")
    missing = led.filter("target is null").join(files.select("path", F.lit(True).alias("there")), "path", "left")
    warnings.append(missing.select(F.when(F.col("there"), "out-of-scope-link").otherwise("unresolved-link").alias("type"), F.col("path").alias("id"), F.col("file_path").alias("file")).distinct())

    out = warnings[0]
    for more in warnings[1:]:
        out = out.unionByName(more)
    edges = plain.unionByName(linked)
    if evidence is not None:
        edges = edges.unionByName(evidence_edges(Graph(nodes, edges), evidence))
    return Graph(nodes, dedup_edges(edges)), out.distinct()
