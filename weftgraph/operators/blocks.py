"""Block structure of Markdown: one fold over a file's lines with a stack of open containers.

A file gives rows for its headings, list items, paragraphs, code, HTML and link
definitions.  What they mean is left to column functions over those rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import dealt

SCHEMA = (
    "path string, seq int, kind string, line int, last int, level int, text string, whole string, notes array<string>, items array<int>, quoted boolean, "
    "boxed boolean, section array<string>, head int, tail int"
)
MATTER = re.compile(r"---[ \t]*")
FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})")
HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)(.*)$")
CLOSING = re.compile(r"(?:^|[ \t])[ \t]*#+[ \t]*$")
MARKER = re.compile(r"([-*+]|\d{1,9}[.)])([ \t]+|$)")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
TAG = re.compile(r"</?[A-Za-z][\w-]*(?:[\s/>]|$)|<[!?]")
DEFINITION = re.compile(r"\[((?:\\.|[^\]\\])+)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
TICKED = re.compile(r"^(.*?)\[[xX]\]")
SECTION = re.compile(r"(#+)\s")
# Opaque parts of running text: code, comments and tags, images, links, escapes.
INLINE = re.compile(
    r"(?P<ticks>`+)(?P<code>(?:(?!(?P=ticks)(?!`)).)*?[^`])(?P=ticks)(?!`)|(?P<html><!--.*?-->|</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>)|<(?P<auto>[A-Za-z][\w+.-]+:[^\s<>]*)>"
    r"|!\[(?P<alt>[^\]]*)\](?:\([^()]*\)|\[[^\]]*\])|\[(?P<name>(?:[^\[\]]|\[[^\[\]]*\])*)\](?P<to>\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\]|)|\\(?P<mark>[!-/:-@\[-`{-~])",
    re.DOTALL,
)
STRESS = [re.compile(p, re.DOTALL) for p in (r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"\*(?=\S)([^*]+?)(?<=\S)\*", r"(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)", r"(?<!\w)_(?=\S)([^_]+?|.+?)(?<=\S)_(?!\w)")]
HIDDEN = re.compile("\ue000(\\d+)\ue001")


def plain(text: str, names: frozenset[str] = frozenset(), bare: bool = False) -> str:
    """What running text says, without its marks; ``bare`` leaves code and HTML out.  ``names`` are the defined link names."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        if m["mark"] is not None:
            said = m["mark"]
        elif m["code"] is not None:
            code = m["code"].replace("\n", " ")
            said = "" if bare else code[1:-1] if code[0] == code[-1] == " " and code.strip() else code
        elif m["html"] is not None:
            said = "" if bare else m["html"]
        elif m["auto"] is not None:
            said = m["auto"]
        elif m["alt"] is not None:
            said = "" if bare else m["alt"]
        elif m["to"].startswith("(") or (m["to"].strip("[]") or m["name"]).lower() in names:
            return plain(m["name"], names, bare)
        else:
            inner = plain(m["name"], names, bare) if m["name"] else ""
            return f"[{inner}]{m['to']}"
        kept.append(said)
        return f"\ue000{len(kept) - 1}\ue001"

    text = re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"(?: {2,}|\\)\n[ \t]*", "", INLINE.sub(hide, text)))
    for stress in STRESS:
        text = stress.sub(r"\1", text)
    return HIDDEN.sub(lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else m[0], html.unescape(text))


def masked(line: str) -> str:
    """A line without its comments and code spans."""
    return re.sub(r"(`+).*?\1", "", re.sub(r"<!--.*?-->", "", line))


@dataclass
class Item:
    """An open list item: its number, where its content starts, and what it has gathered."""

    number: int
    width: int
    line: int
    quoted: bool
    above: list[int]
    label: str | None = None
    notes: list[str] = field(default_factory=list)
    whole: list[str] = field(default_factory=list)
    boxed: bool = False


@dataclass
class Leaf:
    kind: str
    line: int
    lines: list[str]
    end: str = ""  # the fence that closes code, or what closes HTML
    last: int = 0
    level: int = 0


class Fold:
    """State of one file: the open containers (``None`` for a block quote), the open leaf, and the rows so far."""

    def __init__(self, path: str, text: str, heading: str):
        lines = text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("\ufeff").split("\n")
        self.path, self.lines, self.heading, self.skip = path, lines, re.compile(heading), 0
        self.mark = "\ufeff" if text.startswith("\ufeff") else ""
        if len(lines) > 1 and MATTER.fullmatch(lines[0]):
            self.skip = next((i + 1 for i in range(1, len(lines)) if MATTER.fullmatch(lines[i])), 0)
        self.stack: list[Item | None] = []
        self.leaf: Leaf | None = None
        self.rows: list[dict] = []
        self.items = 0
        self.names = frozenset(m[1].lower() for x in lines[self.skip :] if (m := DEFINITION.match(x.strip())))

    def row(self, kind: str, line: int, **more) -> dict:
        own = [c.number for c in self.stack if c]
        row = {"path": self.path, "seq": len(self.rows), "kind": kind, "line": line, "last": line, "items": own, "quoted": None in self.stack} | more
        self.rows.append(row)
        return row

    def close_leaf(self) -> None:
        """Write the open leaf as a row, and what it says into the items around it."""
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        if leaf.kind == "paragraph":
            while leaf.lines and (m := DEFINITION.match(leaf.lines[0].strip())):
                self.row("definition", leaf.line, text=m[2], whole=m[1].lower())
                leaf.lines, leaf.line = leaf.lines[1:], leaf.line + 1
            if not leaf.lines:
                return
        raw = "\n".join(leaf.lines)
        if leaf.kind in ("paragraph", "heading"):
            raw = raw.strip()
        said = plain(raw, self.names) if leaf.kind in ("paragraph", "heading") else raw.rstrip("\n")
        more = {"last": leaf.last, "text": said, "whole": raw, "level": leaf.level}
        if leaf.kind == "heading":
            more |= self.section(leaf, said)
        self.row(leaf.kind, leaf.line, **more)
        inner = self.stack[-1] if self.stack else None
        for c in self.stack:
            if c:
                c.whole.append(said)
        if inner and leaf.kind == "paragraph" and inner.label is None:
            inner.label, inner.notes = said, [plain(raw, self.names, bare=True)]
            inner.boxed = len(inner.whole) == 1 and re.match(r"\[[xX]\](?:\s|$)", raw) is not None

    def section(self, leaf: Leaf, said: str) -> dict:
        """Of a heading that names a requirement: its section's lines, its first paragraph's place in them, and that one's outer lines."""
        if not self.heading.search(said):
            return {}
        start, total = leaf.line - 1, len(self.lines)
        level = len(m[1]) if (m := re.match(r"(#+)", self.lines[start])) else 1
        end = next((i for i in range(start + 1, total) if (m := SECTION.match(self.lines[i])) and len(m[1]) <= level), total)
        head = next((i for i in range(start + 1, total) if self.lines[i].strip()), total)
        if head == total or SECTION.match(self.lines[head]):
            return {"section": self.lines[start:end], "last": end}
        tail = head
        while tail + 1 < total and self.lines[tail + 1].strip() and not SECTION.match(self.lines[tail + 1]):
            tail += 1
        edges = [self.lines[i] for i in sorted({head, tail})]
        notes = [masked(x) for x in edges if not re.match(r"\s*>", x)]
        return {"section": self.lines[start:end], "last": end, "head": head - start, "tail": tail - start, "notes": notes}

    def close(self, depth: int) -> None:
        """Close the leaf and the containers below ``depth``."""
        self.close_leaf()
        while len(self.stack) > depth:
            item = self.stack[-1]
            if item is not None:
                label = item.label if item.label is not None else "".join(item.whole)
                self.row("item", item.line, text=label, whole="".join(item.whole), notes=[] if item.quoted else item.notes or [label], level=len(item.above) + 1, boxed=item.boxed)
            self.stack.pop()

    def step(self, n: int, line: str) -> None:
        """Take in line ``n`` (from 1)."""
        rest = line.expandtabs(4) if "\t" in line[: len(line) - len(line.lstrip())] else line
        depth = 0
        for c in self.stack:
            room = len(rest) - len(rest.lstrip(" "))
            if c is None:
                if room > 3 or not rest.lstrip(" ").startswith(">"):
                    break
                rest = rest.lstrip(" ")[1:].removeprefix(" ")
            elif not rest.strip():
                rest = ""
            elif room >= c.width:
                rest = rest[c.width :]
            else:
                break
            depth += 1
        whole = depth == len(self.stack)
        leaf = self.leaf
        if whole and leaf and leaf.kind == "code" and leaf.end:
            mark = rest.strip()
            if len(rest) - len(rest.lstrip(" ")) < 4 and mark and set(mark) == {leaf.end[0]} and len(mark) >= len(leaf.end):
                leaf.last = n
                self.close_leaf()
            else:
                leaf.lines.append(rest)
                leaf.last = n
            return
        if whole and leaf and leaf.kind == "html":
            if leaf.end or rest.strip():
                leaf.lines.append(rest)
                leaf.last = n
                if leaf.end and leaf.end in rest:
                    self.close_leaf()
                return
        paragraph = leaf is not None and leaf.kind == "paragraph"
        opened = False
        while rest.strip():
            room = len(rest) - len(rest.lstrip(" "))
            body = rest.lstrip(" ")
            running = paragraph and whole and not opened
            if room > 3:
                if not paragraph or opened:
                    if opened or not whole or not (self.leaf and self.leaf.kind == "code"):
                        self.close(depth)
                        self.leaf = Leaf("code", n, [], last=n)
                    self.leaf.lines.append(rest[4:])
                    self.leaf.last = n
                    return
                break
            if body.startswith(">"):
                self.close(depth)
                self.stack.append(None)
                rest = body[1:].removeprefix(" ")
            elif m := HEADING.match(body):
                self.close(depth)
                self.leaf = Leaf("heading", n, [CLOSING.sub("", m[2])], last=n, level=len(m[1]))
                return self.close_leaf()
            elif m := FENCE.match(body):
                self.close(depth)
                self.leaf = Leaf("code", n, [], end=m[1], last=n)
                return None
            elif TAG.match(body) and not running:
                self.close(depth)
                end = "-->" if body.startswith("<!--") else ""
                self.leaf = Leaf("html", n, [rest], end=end, last=n)
                return self.close_leaf() if end and end in body else None
            elif running and UNDERLINE.match(body):
                self.leaf.kind, self.leaf.level, self.leaf.last = "heading", 1 if body[0] == "=" else 2, n
                return self.close_leaf()
            elif RULE.match(body):
                self.close(depth)
                return None
            elif (m := MARKER.match(body)) and not (running and (not body[m.end() :].strip() or m[1][:-1] not in ("", "1"))):
                self.close(depth)
                gap = len(m[2].expandtabs(4))
                after = body[m.end() :]
                width = room + len(m[1]) + (1 if gap > 4 or not after.strip() else gap)
                rest = (" " * (gap - 1) if gap > 4 else "") + after
                self.stack.append(Item(self.items, width, n, None in self.stack, [c.number for c in self.stack if c]))
                self.items += 1
            else:
                break
            opened, paragraph = True, False
            depth = len(self.stack)
        if not rest.strip():
            if opened:
                return
            if not whole:  # a block quote ends, lists stay open
                self.close(depth)
            elif leaf and leaf.kind == "code":
                leaf.lines.append("")
            else:
                self.close_leaf()
            return
        if paragraph and not opened:  # also of an unfinished container: lazy continuation
            self.leaf.lines.append(rest.strip(" "))
            self.leaf.last = n
            return
        self.close(depth)
        self.leaf = Leaf("paragraph", n, [rest.lstrip(" ")], last=n)

    def run(self) -> list[dict]:
        for n in range(self.skip, len(self.lines)):
            self.step(n + 1, self.lines[n])
        self.close(0)
        # The document's own hash counts ticked boxes of items as open ones.
        boxes = {r["line"] for r in self.rows if r.get("boxed")}
        text = "\n".join(TICKED.sub(r"\1[ ]", x, count=1) if i in boxes else x for i, x in enumerate(self.lines, 1))
        self.row("document", 1, last=len(self.lines), text=hashlib.sha256((self.mark + text).encode("utf-8", "replace")).hexdigest()[:16])
        return self.rows


def blocks(files: DataFrame, heading: str) -> DataFrame:
    """Rows of the blocks of ``files(path, text)``; a table of blocks is returned as it is.

    kind is heading, item, paragraph, code, html, definition or document (its text
    is the file's hash, ticked boxes of items taken as open); line to last are
    its lines in the file; level is a heading's or an item's depth; text is what
    it says (an item's is its first paragraph), whole the text of all that an item
    holds; notes are the texts where annotations may stand; items are the numbers
    of the list items around it, innermost last (an item's own included); boxed: an
    item opens with a ticked box.  A heading that ``heading`` fits has the lines of its section, and
    head to tail, its first paragraph's places in them.  Null texts have no blocks;
    a file is folded in one pass, linear in its lines, and is held once.
    """
    if "notes" in files.columns:
        return files
    schema = pa.schema([("path", pa.string()), ("seq", pa.int32()), ("kind", pa.string()), ("line", pa.int32()), ("last", pa.int32()), ("level", pa.int32()), ("text", pa.string()), ("whole", pa.string()),
        ("notes", pa.list_(pa.string())), ("items", pa.list_(pa.int32())), ("quoted", pa.bool_()), ("boxed", pa.bool_()), ("section", pa.list_(pa.string())), ("head", pa.int32()), ("tail", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    yield pa.RecordBatch.from_pylist(Fold(path, text, heading).run(), schema)

    return dealt(files.select("path", F.col("text").cast("string").alias("text"))).mapInArrow(run, SCHEMA)
