"""Rows from specification and code text: requirements, annotations, tasks, tags, symbols and imports.

Specifications are read from their blocks, code from its declarations; both are
folded once from text, and what they mean is told by built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import NAMESPACED, TOKEN, plain_path
from ..graph import short_hash, stored
from .blocks import blocks
from .declarations import declarations
from .resolve import Options, targets

# The input format of annotations and of headings that are requirements.
HEADING = r"^Requirement\s+(\d+)\s*(?::|$)"
ANNOTATION = r"\(\s*(depends_on|derives_from)\s*:\s*([^()]*?)\)"
# Code spans and comments: what they hold is no markup.
MASKED = r"(`+)(?:(?!`).)+?\1(?!`)|<!--.*?-->"
FENCE = r"^\s*(?:```|~~~)"
# White space inside a line, Unicode blanks and the BOM included.
BLANK = r"[ \t\x0B\f\r\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000\uFEFF]"


def lines_of(files: DataFrame) -> DataFrame:
    """path, n (from 1), line and in_fence of ``files(path, text)``; line ends are normalised."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    rows = files.select("path", F.posexplode(F.split(text, "\n")).alias("i", "line")).select("path", (F.col("i") + 1).alias("n"), "line")
    fence = F.col("line").rlike(FENCE)
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    count = F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0))
    return rows.withColumn("in_fence", fence | (count % 2 == 1))


def stripped(text):
    """Text without annotations and the blanks around them: gone at a line's edge, one blank inside; lines lose their last blanks."""
    edge = F.regexp_replace(text, rf"(?m)(?:^[ \t]*{ANNOTATION}[ \t]*|[ \t]*{ANNOTATION}[ \t]*$)", "")
    return F.regexp_replace(F.regexp_replace(edge, rf"[ \t]*{ANNOTATION}[ \t]*", " "), r"(?m)[ \t]+$", "")


def requirements(files: DataFrame, token: str = TOKEN, heading: str = HEADING) -> DataFrame:
    """id, file_path, line, label and content_hash of requirements in list items and headings, of files or their blocks.

    ``token`` is the id grammar of list items; what ``heading`` captures of a
    heading is the id, behind ``Requirement-`` if it is a number.  An item's hash
    is of all that it holds, a heading's of its section; annotations count in
    neither.
    """
    found = blocks(files, heading)
    item = found.filter("kind = 'item'").withColumn("id", F.regexp_extract("text", rf"^(?:\*\*)?({token})(?:\*\*)?[:\s]", 1)).filter("id <> ''")
    items = item.select("id", F.col("path").alias("file_path"), "line", F.col("text").alias("label"), short_hash(stripped(F.col("whole"))).alias("content_hash"))
    head = found.filter("kind = 'heading' and section is not null")
    # Of the first paragraph each line loses its annotations; lines that were nothing else go, and with all of them the blank line above.
    cut = F.transform(F.slice("section", F.col("head") + 1, F.col("tail") - F.col("head") + 1), stripped)
    gone = F.forall(cut, lambda x: F.trim(x) == "")
    upper = F.slice("section", 1, F.col("head") - F.when(gone & (F.trim(F.get("section", F.col("head") - 1)) == ""), 1).otherwise(0))
    lower = F.slice("section", F.col("tail") + 2, F.size("section"))
    body = F.when(F.col("head").isNull(), F.col("section")).otherwise(F.concat(upper, F.filter(cut, lambda x: F.trim(x) != ""), lower))
    sections = head.select(heading_id(heading).alias("id"), F.col("path").alias("file_path"), "line", F.col("text").alias("label"), short_hash(F.array_join(body, "\n")).alias("content_hash"))
    return items.unionByName(sections)


def heading_id(heading: str):
    """The id that a heading's text names."""
    own = F.regexp_extract("text", heading, 1)
    return F.when(own.rlike(r"^\d+$"), F.concat(F.lit("Requirement-"), own)).otherwise(own)


def annotations(files: DataFrame, token: str = TOKEN, heading: str = HEADING) -> DataFrame:
    """source, kind, target, file_path and status (valid, invalid or empty) of ``(depends_on: A, B)`` on requirements.

    Read are an item's first paragraph and the first and last line of a heading's;
    code spans, comments and block quotes hold none.
    """
    found = blocks(files, heading)
    of_item = F.regexp_extract("text", rf"^(?:\*\*)?({token})(?:\*\*)?[:\s]", 1)
    source = F.when(F.col("kind") == "item", of_item).when(F.col("section").isNotNull(), heading_id(heading)).otherwise("")
    notes = found.filter(F.col("kind").isin("item", "heading")).select(source.alias("source"), F.col("path").alias("file_path"), F.explode("notes").alias("note")).filter("source <> ''")
    found = notes.select("source", "file_path", F.explode(F.regexp_extract_all("note", F.lit(ANNOTATION), F.lit(0))).alias("a"))
    named = F.filter(F.transform(F.split(F.regexp_extract("a", ANNOTATION, 2), ","), lambda x: F.trim(F.regexp_replace(x, r"\s", " "))), lambda x: x != "")
    bare = F.transform(named, lambda x: F.trim(F.regexp_replace(x, r"^\*\*(.+)\*\*$", "$1")))
    rows = found.select("source", F.regexp_extract("a", ANNOTATION, 1).alias("kind"), F.explode_outer(bare).alias("target"), "file_path")
    status = F.when(F.col("target").isNull(), "empty").when(F.col("target").rlike(rf"^(?:[\w-]+/)?(?:{token})$"), "valid").otherwise("invalid")
    return rows.withColumn("status", status)


def front_matter(files: DataFrame, key: str = "graph") -> DataFrame:
    """path, node_id, title, status, priority, owner, derives_from and depends_on of each file that opens with front matter.

    Read are plain and quoted scalars, flow lists and block lists, the ids below ``key``.
    """
    block = files.select("path", F.regexp_extract("text", r"\A---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1).alias("y")).filter("y <> ''")
    below = F.regexp_extract("y", rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]+.*(?:\r?\n|\z))*)", 1)
    scalar = lambda c, k: F.nullif(F.regexp_extract(c, rf"(?m)^[ \t]*{k}:[ \t]*[\"']?([^\"'\n\[]*?)[\"']?[ \t]*$", 1), F.lit(""))

    def listed(c, k):
        flow = F.regexp_extract(c, rf"(?m)^[ \t]*{k}:[ \t]*\[([^\]]*)\]", 1)
        rows = F.regexp_extract(c, rf"(?m)^[ \t]*{k}:[ \t]*\r?\n((?:[ \t]*-[ \t].*(?:\r?\n|\z))*)", 1)
        every = F.concat(F.split(flow, ","), F.regexp_extract_all(rows, F.lit(r"-[ \t]+(.*)"), F.lit(1)))
        return F.filter(F.transform(every, lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")), lambda x: x != "")

    out = block.withColumn("b", below)
    own = [scalar(F.col("y"), k).alias(k) for k in ("title", "status", "priority", "owner")]
    return out.select("path", scalar(F.col("b"), "node_id").alias("node_id"), *own, listed(F.col("b"), "derives_from").alias("derives_from"), listed(F.col("b"), "depends_on").alias("depends_on"))


def unknown_relations(files: DataFrame, key: str = "graph") -> DataFrame:
    """path and key of entries below ``key`` in the front matter that are no relation and no id."""
    block = F.regexp_extract("text", r"\A---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    below = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]+.*(?:\r?\n|\z))*)", 1)
    keys = F.regexp_extract_all(below, F.lit(r"(?m)^[ \t]+([A-Za-z_][\w-]*):"), F.lit(1))
    return files.select("path", F.explode(keys).alias("key")).filter(~F.col("key").isin("node_id", "derives_from", "depends_on"))


@dataclass(frozen=True)
class Convention:
    """How tasks are written: the stems of their files, and what their id and tags look like.

    ``verifies_list`` captures a whole list of which ``verifies`` captures the
    entries; without it ``verifies`` is looked for anywhere.  Targets are in the
    space of requirements if ``space`` says so.
    """

    name: str
    stems: tuple[str, ...]
    task_id: str
    implements: str | None = None
    verifies: str | None = None
    verifies_list: str | None = None
    space: str | None = None


# The task conventions that are known without being told.
CONVENTIONS = (
    Convention("spec-kit", ("plan", "tasks"), r"^(?:\[[xX ]\][\s\u00A0]+)?(T\d+)\b", r"@impl\(([^)\n]+)\)", rf"\[((?:REQ-[\w/-]+)|(?:{NAMESPACED}))\]"),
    Convention("kiro", ("tasks",), r"^\[[xX ]\][\s\u00A0]+(\d+(?:\.\d+)*)\.?[\s\u00A0]", None, r"(\d+(?:\.\d+)*)", r"Requirements:([\s\d.,]*)", "requirement"),
)


def captures(texts: Column, pattern: str) -> Column:
    """What the pattern's first group captures, an array for each text."""
    return F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(1)))


def tasks(files: DataFrame, conventions: tuple[Convention, ...] = CONVENTIONS, heading: str = HEADING) -> tuple[DataFrame, DataFrame]:
    """Tasks (id, file_path, line, convention, content_hash), and their edges to what they implement and verify.

    ``conventions`` are tried in order for a file of their stems; the first whose
    task id fits a list item is the item's.  A task's tags are those of its own
    paragraphs, nested ones too, but for those of a nested task.
    """
    stem = F.lower(F.regexp_extract("path", r"([^/]*)\.[^./]+$", 1))
    found = blocks(files, heading).filter(stem.isin(*{s for c in conventions for s in c.stems}) & F.col("kind").isin("item", "paragraph"))
    task = F.lit(None).cast("struct<id:string,convention:string>")
    for c in reversed(conventions):
        got = F.regexp_extract("text", c.task_id, 1)
        task = F.when((F.col("kind") == "item") & stem.isin(*c.stems) & (got != ""), F.struct(got.alias("id"), F.lit(c.name).alias("convention"))).otherwise(task)
    marked = found.withColumn("task", task)
    own = marked.filter("task is not null").select("path", F.element_at("items", -1).alias("item"), "line", "task", "whole")
    nodes = own.select("task.id", F.col("path").alias("file_path"), "line", "task.convention", short_hash(F.col("whole")).alias("content_hash"))
    # A paragraph belongs to the innermost task around it.
    inside = found.filter("kind = 'paragraph'").select("path", "seq", "text", F.posexplode("items").alias("depth", "item"))
    held = inside.join(own.select("path", "item", "task"), ["path", "item"]).groupBy("path", "seq").agg(F.max_by(F.struct("text", "task"), "depth").alias("own"))
    held = held.select(F.col("path").alias("file_path"), "own.text", F.col("own.task.id").alias("source"), F.col("own.task.convention").alias("convention"))
    edges = None
    for c in conventions:
        for kind, pattern in (("implements", c.implements), ("verifies", c.verifies)):
            if pattern is None:
                continue
            space = c.space if kind == "verifies" else None
            texts = F.array("text") if kind == "implements" or c.verifies_list is None else F.regexp_extract_all("text", F.lit(c.verifies_list), F.lit(1))
            every = F.flatten(captures(texts, pattern))
            tags = F.split(F.array_join(every, ","), ",")
            major = F.regexp_extract("t", r"^(\d+)(?:\.|$)", 1)
            target = F.when(major != "", F.concat(F.lit("Requirement-"), major)).otherwise(F.col("t")) if space == "requirement" else F.col("t")
            rows = held.filter(F.col("convention") == c.name).select("source", F.explode(tags).alias("t"), "file_path").withColumn("t", F.trim("t"))
            part = rows.filter("t <> ''").select("source", target.alias("target"), F.lit(kind).alias("kind"), F.lit(space).cast("string").alias("target_space"), "file_path")
            edges = part if edges is None else edges.unionByName(part)
    return nodes, edges.distinct()


def inline_links(files: DataFrame) -> DataFrame:
    """file_path and target path of Markdown links to ``.md`` files, outside code; other schemes and paths out of the root are left out."""
    lines = lines_of(files).filter(~F.col("in_fence")).withColumn("line", F.regexp_replace("line", r"`[^`]*`", ""))
    inline = F.regexp_extract_all("line", F.lit(r"(?<!!)\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)"), F.lit(1))
    named = F.regexp_extract_all("line", F.lit(r"^\s{0,3}\[[^\]]+\]:\s*<?([^\s>]+)>?"), F.lit(1))
    rows = lines.select("path", F.explode(F.concat(inline, named)).alias("href")).withColumn("href", F.regexp_replace("href", r"[#?].*$", ""))
    rows = rows.filter(~F.col("href").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|/)") & F.col("href").rlike(r"(?i)\.md$"))
    target = plain_path(F.concat(F.regexp_extract("path", r"^(.*?)[^/]*$", 1), F.coalesce(F.try_url_decode(F.regexp_replace("href", r"\+", "%2B")), F.col("href"))))
    return rows.select(F.col("path").alias("file_path"), target.alias("target")).filter("target is not null").distinct()


def implementation_tags(files: DataFrame, token: str = TOKEN) -> DataFrame:
    """path, line and req_id of ``// @impl A, B``, where the tag opens its line comment; of code files or their declarations."""
    # Fixed value: the input format of tags in line comments.
    named = rf"(?:[\w-]+/)?(?:{token})"
    tag = rf"^//+{BLANK}*@impl{BLANK}+((?:{named}(?:{BLANK}|,)*)+)"
    rows = declarations(files).filter("kind = 'tag'").select("path", F.col("start").alias("line"), F.regexp_extract("name", tag, 1).alias("ids")).filter("ids <> ''")
    return rows.select("path", "line", F.explode(F.regexp_extract_all("ids", F.lit(named), F.lit(0))).alias("req_id")).distinct()


def test_tags(files: DataFrame, token: str = TOKEN) -> DataFrame:
    """path and req_id of ``[ID]`` and ``req: "ID"`` anywhere in a test file."""
    # The input format of tags in tests.
    named = rf"(?:[\w-]+/)?(?:{token})"
    both = F.concat(F.regexp_extract_all("text", F.lit(rf"\[({named})\]"), F.lit(1)), F.regexp_extract_all("text", F.lit(rf"req:\s*[\"']?({named})[\"']?"), F.lit(1)))
    return files.select("path", F.explode(F.array_distinct(both)).alias("req_id"))


def symbols(files: DataFrame) -> DataFrame:
    """path, name, id, start, end, seq, grp, owner (a member's class) and content_hash of exported symbols and class members."""
    id_ = lambda c: F.concat(F.lit("symbol:"), "path", F.lit("#"), c)
    found = declarations(files).filter("kind = 'symbol'")
    return found.select("path", "name", id_("name").alias("id"), "start", "end", F.col("start").alias("seq"), "grp", F.when(F.col("owner").isNotNull(), id_("owner")).alias("owner"), "content_hash")


def exported_symbols(files: DataFrame) -> DataFrame:
    """The ``symbols`` that are no members."""
    return symbols(files).filter("owner is null")


def specifiers(declared: DataFrame, files: DataFrame, options: Options = Options(), modules: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """path, kind, name, given, spec and target of the imports and re-exports among ``declared`` that lead from a relative path to a known file; rows that have targets are returned as they are."""
    if "target" in declared.columns:
        return declared
    # Joined to what is made of them, so stored: code is read once.
    rows = stored(declared.filter(F.col("kind").isin("import", "reexport") & F.col("spec").startswith(".")).select("path", "kind", "name", "given", "spec"))
    return rows.join(targets(rows, files, options, modules), ["path", "spec"])


def unresolved_specifiers(declared: DataFrame, found: DataFrame) -> DataFrame:
    """path, kind and spec of relative imports and re-exports among ``declared`` that are not ``found(path, spec)``."""
    rows = declared.filter(F.col("kind").isin("import", "reexport") & F.col("spec").startswith(".")).select("path", "kind", "spec").distinct()
    return rows.join(found.select("path", "spec").distinct(), ["path", "spec"], "anti")


def imports(files: DataFrame, declared: DataFrame | None = None, *how) -> DataFrame:
    """source and target file ids of relative imports and re-exports that lead to a known file."""
    found = specifiers(declarations(files) if declared is None else declared, files, *how)
    return found.select(F.concat(F.lit("file:"), "path").alias("source"), F.concat(F.lit("file:"), "target").alias("target")).distinct()


def named_imports(files: DataFrame, declared: DataFrame | None = None, *how) -> DataFrame:
    """source and target ids of imports at symbol grain.

    Named and default imports lead to symbols, namespace, bare and star forms to
    the file.  A re-exported name leads from the symbol that it makes here; a
    namespace that is handed on leads from the file and from its symbol.
    """
    found = specifiers(declarations(files) if declared is None else declared, files, *how)
    here, there = F.concat(F.lit("file:"), "path"), F.concat(F.lit("file:"), "target")
    symbol = lambda path, name: F.concat(F.lit("symbol:"), path, F.lit("#"), name)
    onward, space = (F.col("kind") == "reexport") & F.col("given").isNotNull(), F.col("name").eqNullSafe("*")
    source = F.when(onward, symbol("path", "given")).otherwise(here)
    target = F.when(F.col("name").isNull() | space, there).otherwise(symbol("target", "name"))
    return found.select(source.alias("source"), target.alias("target")).union(found.filter(onward & space).select(here, there)).distinct()


def reexports(files: DataFrame, declared: DataFrame | None = None, *how) -> DataFrame:
    """path, name, id and content_hash of the symbols that re-exports make: the hash is of target, origin (``*`` for a namespace) and name."""
    found = specifiers(declarations(files) if declared is None else declared, files, *how).filter("kind = 'reexport' and given is not null")
    id_ = F.concat(F.lit("symbol:"), "path", F.lit("#"), "given")
    hashed = short_hash(F.concat_ws("\0", "target", "name", "given"))
    # The first of a name by origin stays.
    return found.groupBy("path", "given").agg(F.min(F.struct("target", "name")).alias("o")).select("path", "given", "o.*").select("path", F.col("given").alias("name"), id_.alias("id"), hashed.alias("content_hash"))


def star_exports(files: DataFrame, declared: DataFrame | None = None, *how) -> DataFrame:
    """path and target of ``export * from``."""
    return specifiers(declarations(files) if declared is None else declared, files, *how).filter("kind = 'reexport' and name is null").select("path", "target").distinct()
