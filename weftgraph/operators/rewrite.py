"""Changes of an id in text: specification definitions, annotations and code tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import BLANK, FENCE


def bounded(id_: str, free: str = "") -> str:
    """The id where no letter, digit, underscore, hyphen, slash or colon touches it; ``free`` may follow."""
    return rf"(?<![\w/:-]){re.escape(id_)}(?![\w/{'' if ':' in free else ':'}-])"


def swap(text: Column, old: str, new: str, free: str = "") -> Column:
    return F.regexp_replace(text, bounded(old, free), new.replace("\\", r"\\").replace("$", r"\$"))


def pieces(text: Column, *kinds: str) -> Column:
    """Text cut into the first fitting of ``kinds`` at each place, and single characters or plain runs between."""
    return F.regexp_extract_all(text, F.lit("|".join(f"(?:{k})" for k in kinds) + r"|[^`<(/'\"\[]+|[\s\S]"), F.lit(0))


def within(text: Column, kind: str, others: list[str], old: str, new: str) -> Column:
    """``text`` with the id swapped in pieces of ``kind`` only; pieces of ``others`` hide what they hold."""
    changed = F.transform(pieces(text, *others, kind), lambda p: F.when(p.rlike(rf"^(?:{kind})$"), swap(p, old, new)).otherwise(p))
    return F.array_join(changed, "")


QUOTED = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
LISTED = r"\(\s*(?:depends_on|derives_from)\s*:[^()]*\)"


# Extensions of code, and what stands for a requirement that is yet to be written.
CODE = r"(?i)\.(?:tsx?|jsx?)$"
SCAFFOLD = "(TODO: describe this requirement)"
BREAK = r"(?<=\n)|(?<=\r)(?!\n)"


def kept_lines(files: DataFrame) -> DataFrame:
    """path, n, line, eol (its own line end) and in_fence of every file, null texts as one empty line with gone set."""
    raw = F.split(F.coalesce("text", F.lit("")), BREAK)
    rows = files.select("path", F.col("text").isNull().alias("gone"), F.posexplode(raw).alias("i", "raw"))
    rows = rows.select("path", "gone", (F.col("i") + 1).alias("n"), F.regexp_replace("raw", r"\r?\n$|\r$", "").alias("line"), F.regexp_extract("raw", r"(\r?\n|\r)$", 1).alias("eol"))
    fence = F.col("line").rlike(FENCE)
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("in_fence", fence | (F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1))


def whole_text(rows: DataFrame, parts: Column, last: Column | None = None) -> DataFrame:
    """path and text put together from lines: ``parts`` are what stands in place of a line, ``last`` what follows the file; between lines stand their own ends."""
    listed = F.array_sort(F.collect_list(F.struct("n", parts.alias("new"), "eol")))
    style = F.when(F.max(F.col("eol") == "\r\n"), "\r\n").otherwise("\n")
    text = rows.groupBy("path").agg(listed.alias("rows"), style.alias("style"), F.max("gone").alias("gone"), *([] if last is None else [last.alias("last")]))
    lines = F.flatten(F.transform("rows", lambda r: F.transform(r["new"], lambda x: F.struct(x.alias("line"), r["eol"].alias("eol")))))
    if last is not None:
        lines = F.concat(lines, F.transform("last", lambda x: F.struct(x.alias("line"), F.lit("").alias("eol"))))
    text = text.withColumn("lines", lines)
    ended = lambda x, i: F.concat(x["line"], F.when(i == F.size("lines") - 1, "").otherwise(F.coalesce(F.nullif(x["eol"], F.lit("")), "style")))
    return text.select("path", F.when(~F.col("gone"), F.array_join(F.transform("lines", ended), "")).alias("text"))


def renamed_lines(files: DataFrame, old: str, new: str) -> DataFrame:
    """The lines of ``files(path, text)`` with new: each with its definitions, references and tags of ``old`` rewritten.

    In Markdown: definitions in list items and ``Requirement N`` headings, entries
    of annotations, and relations of the front matter; fenced code, block quotes,
    code spans and comments stay.  In code: ``// @impl`` lists outside strings,
    ``[ID]`` and ``req: "ID"`` tags.  Other files and prose are never touched, and
    every entry of a list is, however long it is.
    """
    lines = kept_lines(files)
    head = r"^---[ \t]*$"
    order = Window.partitionBy("path").orderBy("n")
    fences = F.sum(F.col("line").rlike(head).cast("int")).over(order)
    opens = F.first(F.col("line").rlike(head)).over(order)
    lines = lines.withColumn("front", opens & (fences == 1))
    line = F.col("line")
    item = rf"^(\s*[-*]\s+(?:\*\*)?){bounded(old, ':')}(?=(?:\*\*)?[:\s]|$)"
    to = new.replace("\\", r"\\").replace("$", r"\$")
    own = F.regexp_replace(line, item, f"$1{to}")
    numbers = [re.fullmatch(r"Requirement-(\d+)", x) for x in (old, new)]
    if all(numbers):
        own = F.regexp_replace(own, rf"^(?<head>#{{1,6}}\s+Requirement\s+){numbers[0][1]}(?=\s*(?::|$|#+[ \t]*$))", f"${{head}}{numbers[1][1]}")
    spec = within(own, LISTED, [r"(`+)(?:(?!`).)+?\1(?!`)", "<!--.*?-->"], old, new)
    matter = F.when(line.rlike(r"^\s*(?:-\s|node_id:|derives_from:|depends_on:)"), swap(line, old, new)).otherwise(line)
    markdown = F.when(F.col("front"), matter).when(F.col("in_fence") | line.rlike(r"^\s{0,3}>"), line).otherwise(spec)
    tag = rf"//{BLANK}*@impl{BLANK}[^\n]*"
    code = within(line, tag, [QUOTED], old, new)
    code = F.regexp_replace(F.regexp_replace(code, rf"(\[){re.escape(old)}(?=\])", f"$1{to}"), rf"(req:\s*[\"']?)(?<![\w/-]){re.escape(old)}(?![\w/-])", f"$1{to}")
    return lines.withColumn("new", F.when(F.col("path").rlike(r"(?i)\.md$"), markdown).when(F.col("path").rlike(CODE), code).otherwise(line))


def rename_in_text(files: DataFrame, old: str, new: str) -> DataFrame:
    """``files(path, text)`` with text rewritten as ``renamed_lines`` says and n_changes, the number of lines that differ.

    What is not rewritten stays byte for byte, line ends included; null texts stay
    null.
    """
    done = renamed_lines(files, old, new)
    count = done.groupBy("path").agg(F.count_if(F.col("new") != F.col("line")).alias("n_changes"))
    return whole_text(done, F.array("new")).join(count, "path")


def rename_changes(files: DataFrame, old: str, new: str) -> DataFrame:
    """path, line, before and after of every line that a rename rewrites."""
    return renamed_lines(files, old, new).filter("new <> line").select("path", F.col("n").alias("line"), F.col("line").alias("before"), F.col("new").alias("after"))


def expand_relations(files: DataFrame, old: str, new: list[str]) -> DataFrame:
    """``files(path, text)`` with each entry ``old`` in the front matter's relations replaced by all of ``new``, as when an id is split."""
    block = r"\A(\uFEFF?---[ \t]*\r?\n[\s\S]*?\r?\n---[ \t]*(?:\r?\n|\z))"
    front = F.regexp_extract("text", block, 1)
    quoted = rf"[\"']?{re.escape(old)}[\"']?"
    rows = F.regexp_replace(front, rf"(?m)^([ \t]*-[ \t]+){quoted}[ \t]*$", "\n".join(f"$1{n}" for n in new))
    flow = F.regexp_replace(rows, rf"(?<=[\[,])([ \t]*){quoted}(?=[ \t]*[,\]])", "$1" + ", ".join(new))
    rest = F.substring(F.col("text"), F.length(front) + 1, F.length("text"))
    return files.withColumn("text", F.concat(flow, rest))


def split_definition(files: DataFrame, old: str, new: list[str]) -> DataFrame:
    """``files`` in which each file that defines ``old`` has an item to be written for each of ``new`` at its end instead; relations fan out."""
    if not new:
        raise ValueError("a definition is split into one id at least")
    return expand_relations(_without_definitions(files, [old], new), old, new)


def merge_definitions(files: DataFrame, old: list[str], new: str, exists: bool = False) -> DataFrame:
    """``files`` without the definitions of ``old``; relations go to ``new``.

    If ``new`` does not exist yet, each file that lost a definition has an item to
    be written for it at its end.
    """
    out = _without_definitions(files, [x for x in old if x != new], [] if exists else [new])
    for id_ in old:
        out = expand_relations(out, id_, [new])
    return out


def _without_definitions(files: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Every file on its own: the lines outside fences that define one of ``old`` go, and if there were any, items of ``new`` come last."""
    any_ = "|".join(map(re.escape, old))
    numbers = "|".join(m[1] for x in old if (m := re.fullmatch(r"Requirement-(\d+)", x)))
    defines = rf"^\s*[-*]\s+(?:\*\*)?(?:{any_})(?:\*\*)?[:\s]" + (rf"|^#{{1,6}}\s+Requirement\s+(?:{numbers})\s*(?::|$|#+[ \t]*$)" if numbers else "")
    hit = ~F.col("in_fence") & F.col("line").rlike(defines) & F.col("path").rlike(r"(?i)\.md$")
    marked = kept_lines(files).withColumn("hit", hit)
    none = F.array().cast("array<string>")
    scaffold = F.array(*[F.lit(f"- {n}: {SCAFFOLD}") for n in new]) if new else none
    return whole_text(marked, F.when(F.col("hit"), none).otherwise(F.array("line")), F.when(F.max("hit"), scaffold).otherwise(none))


def rename_in_titles(tests: DataFrame, old: str, new: str) -> DataFrame:
    """Trace records with ``[old]`` tags of title and suite path rewritten."""
    tag = lambda c: F.replace(c, F.lit(f"[{old}]"), F.lit(f"[{new}]"))
    return tests.withColumns({"test_name": tag(F.col("test_name")), "suite_path": F.transform("suite_path", tag)})


def refused_references(edges: DataFrame, old: str) -> DataFrame:
    """Task references to ``old`` in another id space, which a rename cannot rewrite: target and the tasks."""
    hit = edges.filter((F.col("target") == old) & F.col("target_space").isNotNull())
    return hit.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("tasks"))


def new_warnings(after: DataFrame, before: DataFrame) -> DataFrame:
    """Warnings that were not there before, by type and id."""
    return after.join(before.select("type", "id").distinct(), ["type", "id"], "anti")
