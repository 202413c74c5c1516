"""Declarations of code files: one pass of a lexer with strings, templates, comments and bracket depth.

A file gives rows for its exported symbols, class members, imports, re-exports
and comments that open with a tag.  Statements are told apart at depth 0 only;
what lies in brackets is skipped by its closing bracket.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import dealt

SCHEMA = "path string, kind string, name string, given string, spec string, owner string, start int, end int, grp int, content_hash string"
# White space before a token is skipped with it: it begins with an ASCII blank, as others begin a word.
LEXER = re.compile(
    r"(?>[ \t-\r\x1c-\x1f]\s*)?+(?:(?P<word>#?[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<mark>=>|\.\.\.|\?\.|[{}()\[\];,:=<>.*@?!&|+\-%^~/])"
    r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<number>\d[\w.]*)|(?P<tick>`)|(?P<other>.)|\Z)",
    re.DOTALL,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.DOTALL)
PAIRS = {")": "(", "]": "[", "}": "{"}
# Words after which an operand comes, so that a slash begins a regular expression and a line end ends nothing.
OPERATORS = frozenset("return typeof instanceof in of new delete void throw case do else yield await extends implements as satisfies keyof is".split())
DECLARED = frozenset("function class interface type enum namespace module const let var abstract declare async export import".split())
BEGINS = DECLARED | frozenset("if for while do switch try return throw break continue with debugger".split())
MODIFIERS = frozenset("public private protected static readonly abstract override async declare accessor get set".split())


@dataclass(slots=True)
class Declared:
    name: str
    start: int
    end: int
    function: bool = False


class Reader:
    """The tokens of one file, and the rows that its statements give."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        # A token a place: its kind, text (of words and marks in ``codes`` too, else empty), ends, whether a line begins before it, and for an opening bracket the place of its closing one, else -1.
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.codes: list[str] = []
        self.begins: list[int] = []
        self.ends: list[int] = []
        self.fresh: list[bool] = []
        self.closes: list[int] = []
        self.comments: list[tuple[int, int]] = []
        self.rows: list[dict] = []
        self.local: dict[str, list[Declared]] = {}
        self.listed: list[tuple[str, str]] = []
        self.names: set[str] = set()
        self.imported: dict[str, tuple[str, str]] = {}
        self.groups, self.module = 0, False
        self.ambient = re.search(r"\.d\.[mc]?ts$", path) is not None
        self.lex()
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]
        self.coded = self.code_lines()

    # Tokens.
    def operand_next(self) -> bool:
        """Whether what comes is an operand, judged by the token before."""
        if not self.kinds:
            return True
        kind, text = self.kinds[-1], self.texts[-1]
        return text in OPERATORS if kind == "word" else kind == "mark" and text not in PAIRS

    def lex(self) -> None:
        text, at, fresh, more = self.text, 0, True, True
        opened: list[int] = []
        templates: list[int] = []  # depth at which an open template's expression began
        kinds, texts, codes, begins, ends, freshes, closes = self.kinds, self.texts, self.codes, self.begins, self.ends, self.fresh, self.closes
        while more:
            more = False
            for m in LEXER.finditer(text, at):
                kind = m.lastgroup
                if kind is None:
                    break
                begin, end = m.span(kind)
                if not fresh and begin > at:
                    fresh = text[at] == "\n" or begin > at + 1 and text.find("\n", at, begin) >= 0
                at = end
                part = code = text[begin:end]
                if kind == "mark":
                    if part in "([{":
                        opened.append(len(kinds))
                    elif part in PAIRS:
                        if part == "}" and templates and templates[-1] == len(opened):
                            templates.pop()
                            kind = "tick"
                        elif opened and texts[opened[-1]] == PAIRS[part]:
                            closes[opened.pop()] = len(kinds)
                    elif part == "/" and self.operand_next() and (m := REGEX.match(text, begin)):
                        at, more, kind, part, code = m.end(), True, "string", m[0], ""
                elif kind == "line" or kind == "block":
                    self.comments.append((begin, end))
                    fresh = fresh or kind == "block" and "\n" in part
                    continue
                elif kind != "word":
                    code = ""
                if kind == "tick":
                    at, more, kind, part, code = TEMPLATE.match(text, end).end(), True, "string", "`", ""
                    if text.startswith("${", at):
                        templates.append(len(opened))
                        at += 2
                    else:
                        at = min(at + 1, len(text))
                kinds.append(kind)
                texts.append(part)
                codes.append(code)
                begins.append(begin)
                ends.append(at)
                freshes.append(fresh)
                closes.append(-1)
                fresh = False
                if more:  # the lexer goes on behind it
                    break
        self.count = len(kinds)
        codes += [""] * 8  # looked at behind the end
        for i in opened:  # never closed: they hold the rest
            closes[i] = self.count - 1

    def code_lines(self) -> list[bool]:
        """Per line (from 1): whether it holds more than blanks and comments."""
        coded = [False] * (len(self.starts) + 2)
        for i, kind in enumerate(self.kinds):
            if self.fresh[i] or kind == "string":  # others share the line of the token before
                first = bisect_right(self.starts, self.begins[i])
                coded[first] = True
                if kind == "string":
                    for line in range(first + 1, self.line(max(self.begins[i], self.ends[i] - 1)) + 1):
                        coded[line] = True
        return coded

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def is_(self, i: int, *texts: str) -> bool:
        return self.codes[i] in texts

    def word(self, i: int) -> str | None:
        """The name at ``i``: a word, or what a string says."""
        if i >= self.count:
            return None
        kind, text = self.kinds[i], self.texts[i]
        return text if kind == "word" else text[1:-1] if kind == "string" and text[:1] in "'\"" else None

    def skip(self, i: int) -> int:
        """The token after ``i``, or after the brackets that ``i`` opens."""
        close = self.closes[i]
        return close + 1 if close >= 0 else i + 1

    def angles(self, i: int) -> int:
        """After the type arguments that open at ``i``; ``i`` itself if they are none."""
        depth, j = 0, i
        while j < self.count:
            code = self.codes[j]
            if code == "<":
                depth += 1
            elif code == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif code in (";", ")", "]", "}", "+", "-", "/", "%", "^"):
                return i
            j = self.skip(j)
        return i

    def ends_before(self, i: int) -> bool:
        """Whether a line end before token ``i`` ends a statement."""
        if not self.fresh[i]:
            return False
        before = self.kinds[i - 1]
        if before == "mark" and self.texts[i - 1] not in (")", "]", "}", "!") or before == "word" and self.texts[i - 1] in OPERATORS and self.texts[i - 1] != "void":
            return False
        kind, text = self.kinds[i], self.texts[i]
        if kind == "word":
            return text not in ("instanceof", "in", "as", "satisfies", "is", "extends")
        return kind in ("number", "other") or kind == "string" and text != "`" or text in ("{", "}", "@", "!", "~")

    def expression(self, i: int, stops: str = ";") -> int:
        """The token at which the expression or type from ``i`` ends: one of ``stops``, a closing bracket, or where a line end ends it."""
        first = i
        while i < self.count:
            code = self.codes[i]
            if self.kinds[i] == "mark" and (code in stops or code in PAIRS) or i > first and self.fresh[i] and self.ends_before(i):
                return i
            if code == "<" and not self.fresh[i] and i > first and self.kinds[i - 1] == "word" and (j := self.angles(i)) > i:
                i = j
            else:
                i = self.skip(i)
        return i

    def end_of(self, i: int) -> int:
        """Where the text ends that goes up to token ``i``, a semicolon there included."""
        if self.is_(i, ";"):
            return self.ends[i]
        return self.last(i)

    def last(self, i: int) -> int:
        """Where the token before ``i`` ends."""
        return self.ends[min(i, self.count) - 1] if i else 0

    # Declarations.
    def function_end(self, i: int) -> int:
        """After a function whose keyword, or whose method name, is before ``i``: its body or, without one, its signature."""
        while i < self.count and not self.is_(i, "("):
            if self.is_(i, "<") and (j := self.angles(i)) > i:
                i = j
            elif self.is_(i, ";", "}", "{", "="):
                return i
            else:
                i += 1
        if i >= self.count:
            return i
        i = self.skip(i)
        if self.is_(i, ":"):
            i += 1
            while i < self.count:
                i = self.angles(i) if self.is_(i, "<") and self.angles(i) > i else self.skip(i)
                if self.is_(i, "{") and not self.is_(i - 1, "|", "&", "=>", ":") or self.is_(i, ";", "}") or i < self.count and self.ends_before(i):
                    break
        return self.skip(i) if self.is_(i, "{") else i

    def body(self, i: int) -> int:
        """The token that opens the body of a class, interface, enum or namespace after ``i``."""
        while i < self.count and not self.is_(i, "{", ";"):
            i = self.angles(i) if self.is_(i, "<") and self.angles(i) > i else self.skip(i)
        return i

    def bindings(self, i: int, end: int) -> Iterator[Declared]:
        """The names that the pattern from ``i`` to ``end`` binds, each with its own element's text."""
        i += 1
        while i < end:
            first, stop = i, i
            while stop < end and not self.is_(stop, ","):
                stop = self.skip(stop)
            if stop > first:
                j = min(first + self.is_(first, "..."), stop - 1)
                colon = next((k for k in range(j + 1, stop) if self.is_(k, ":")), None) if self.closes[j] < 0 else None
                if self.is_(j, "[") and self.is_(self.skip(j), ":"):  # a computed key
                    colon = self.skip(j)
                target = colon + 1 if colon is not None and not any(self.is_(k, "=") for k in range(j, colon)) else j
                if self.is_(target, "{", "["):
                    yield from self.bindings(target, self.closes[target])
                elif target < stop and self.kinds[target] == "word":
                    yield Declared(self.texts[target], self.begins[first], self.ends[stop - 1])
            i = stop + 1

    def variables(self, i: int) -> tuple[list[Declared], int]:
        """The names that ``const``, ``let`` or ``var`` before ``i`` declares, and the token after."""
        found = []
        while i < self.count:
            first = i
            target = self.skip(i)
            if self.is_(target, "!"):
                target += 1
            if self.is_(target, ":"):
                target = self.expression(target + 1, "=,;")
            if self.is_(target, "="):
                target = self.expression(target + 1, ",;")
            elif self.is_(target, "of", "in"):
                return found, target
            last = self.last(target)
            if self.is_(first, "{", "["):
                found += self.bindings(first, self.closes[first])
            elif self.kinds[first] == "word":
                found.append(Declared(self.texts[first], self.begins[first], last))
            if not self.is_(target, ","):
                return found, target
            i = target + 1
        return found, i

    def members(self, i: int) -> dict[str, list[tuple[int, int]]]:
        """Methods and function-valued properties of the class whose body opens at ``i``, with their spans."""
        found: dict[str, list[tuple[int, int]]] = {}
        end, i = self.closes[i], i + 1
        while i < end:
            if self.is_(i, ";"):
                i += 1
                continue
            first, declared = i, False
            while self.is_(i, "@"):
                i = self.expression_of_decorator(i)
            while i < end and (self.is_(i, "*") or self.texts[i] in MODIFIERS and not self.is_(i + 1, "(", "<", "=", ":", ";", "?", "!", "}", ",")):
                declared = declared or self.is_(i, "declare")
                i += 1
            if i >= end:
                break
            if self.is_(i, "{"):  # a static block
                i = self.skip(i)
                continue
            name = self.texts[i] if self.kinds[i] == "word" and not self.texts[i].startswith("#") else None
            i = self.skip(i)
            while self.is_(i, "?", "!"):
                i += 1
            if self.is_(i, "(", "<"):
                i = self.function_end(i)
                last = self.end_of(i)
            else:
                if self.is_(i, ":"):
                    i = self.expression(i + 1, "=;")
                value = i + 1 if self.is_(i, "=") else None
                if value is not None:
                    i = self.expression(value, ";")
                last = self.end_of(i)
                if value is None or declared or not self.is_function(value, i):
                    name = None
            if name:
                found.setdefault(name, []).append((self.begins[first], last))
            i = max(i, first + 1)
        return found

    def is_function(self, i: int, end: int) -> bool:
        """Whether the expression from ``i`` is a function or an arrow."""
        if self.is_(i, "async"):
            i += 1
        if self.is_(i, "function"):
            return True
        if self.is_(i, "<"):
            i = self.angles(i)
        if not (self.is_(i, "(") or i < end and self.kinds[i] == "word"):
            return False
        i = self.skip(i)
        if self.is_(i, ":"):
            while i < end and not self.is_(i, "=>"):
                i = self.skip(i)
        return self.is_(i, "=>")

    def expression_of_decorator(self, i: int) -> int:
        i += 1
        while i < self.count and (self.kinds[i] == "word" or self.is_(i, ".")):
            i += 1
            if not self.is_(i, ".") and not self.is_(i - 1, "."):
                break
        return self.skip(i) if self.is_(i, "(") else i

    # Rows.
    def symbol(self, name: str, start: int, end: int, group: int, first: int | None = None, last: int | None = None, members: dict | None = None, owner: str | None = None, hashed: str | None = None) -> None:
        if owner is None:
            if name in self.names:  # the first export of a name stays
                return
            self.names.add(name)
        upper = self.line(start if first is None else first)
        floor = self.line(self.floor) if owner else 1
        while upper > floor and not self.coded[upper - 1]:  # comments and blank lines above belong to it
            upper -= 1
        body = self.text[start:end] if hashed is None else hashed
        self.rows.append({
            "path": self.path, "kind": "symbol", "name": name, "owner": owner, "start": upper, "end": self.line(max(start, (end if last is None else last) - 1)), "grp": group,
            "content_hash": hashlib.sha256(body.encode("utf-8", "replace")).hexdigest()[:16],
        })
        for member, spans in (members or {}).items():
            self.floor = start
            whole = "\0".join(self.text[a:b] for a, b in spans)
            for a, b in spans:
                self.symbol(f"{name}.{member}", a, b, self.group(), owner=name, hashed=whole)

    def group(self) -> int:
        self.groups += 1
        return self.groups

    def link(self, kind: str, spec: str, name: str | None = None, given: str | None = None) -> None:
        self.rows.append({"path": self.path, "kind": kind, "spec": spec, "name": name, "given": given})

    def pairs(self, i: int) -> list[tuple[str, str]]:
        """Names and the names given to them in the braces that open at ``i``."""
        out, end, i = [], self.closes[i], i + 1
        while i < end:
            stop = next((k for k in range(i, end) if self.is_(k, ",")), end)
            if self.is_(i, "type") and stop - i > 1 and not self.is_(i + 1, "as") or self.is_(i, "type") and stop - i == 4:
                i += 1
            name = self.word(i) if i < stop else None
            given = self.word(i + 2) if stop - i >= 3 and self.is_(i + 1, "as") else name
            if name is not None and given is not None:
                out.append((name, given))
            i = stop + 1
        return out

    def source(self, i: int) -> str | None:
        """The specifier after ``from`` at ``i``."""
        return self.word(i + 1) if self.is_(i, "from") and i + 1 < self.count and self.kinds[i + 1] == "string" else None

    def imports(self, i: int) -> int:
        """An import statement whose keyword is before ``i``."""
        if i < self.count and self.kinds[i] == "string":
            self.link("import", self.word(i) or "")
            return i + 1
        if self.is_(i, "type") and not self.is_(i + 1, "from", ",", "="):
            i += 1
        found, whole = [], True
        if i < self.count and self.kinds[i] == "word":
            if self.is_(i + 1, "=") and self.is_(i + 2, "require") and self.is_(i + 3, "("):
                self.link("import", self.word(i + 4) or "")
                return self.skip(i + 3)
            found.append(("default", self.texts[i]))
            i += 1 + self.is_(i + 1, ",")
        if self.is_(i, "*"):
            self.imported[self.word(i + 2) or ""] = ("*", "")
            found, whole, star, i = [(None, self.word(i + 2))], False, True, i + 3
        elif self.is_(i, "{"):
            found += self.pairs(i)
            i = self.skip(i)
        spec = self.source(i)
        if spec is None:
            return i
        for name, given in found:
            self.link("import", spec, name)
            if given:
                self.imported[given] = (name or "*", spec)
        if not found and whole:
            self.link("import", spec)
        return i + 2

    def exports(self, i: int, start: int) -> int:
        """What stands behind ``export`` before ``i``, if it is no declaration; ``i`` itself otherwise."""
        if self.is_(i, "type") and self.is_(i + 1, "{", "*"):
            i += 1
        if self.is_(i, "*"):
            name = self.word(i + 2) if self.is_(i + 1, "as") else None
            at = i + 3 if name is not None else i + 1
            if (spec := self.source(at)) is not None:
                self.link("reexport", spec, "*" if name else None, name)
            return at + 2
        if self.is_(i, "{"):
            named, after = self.pairs(i), self.skip(i)
            if (spec := self.source(after)) is not None:
                for name, given in named:
                    self.link("reexport", spec, name, given)
                if not named:
                    self.link("import", spec)
                return after + 2
            self.listed += named
            return after
        if self.is_(i, "="):
            return self.expression(i + 1)
        if self.is_(i, "as") and self.is_(i + 1, "namespace"):
            return i + 3
        return i

    def declare(self, name: str | None, start: int, end: int, exported: bool, default: bool, function: bool = False, members: dict | None = None) -> None:
        if name:
            self.local.setdefault(name, []).append(Declared(name, start, end, function))
        if exported and (default or name):
            self.later.append((not function, "default" if default else name, start, end, members))

    def statement(self, i: int) -> int:
        """Read the statement at ``i``; the token after it."""
        first = start = i
        while self.is_(i, "@"):
            i = self.expression_of_decorator(i)
        exported = self.is_(i, "export")
        self.module = self.module or exported or self.is_(i, "import") and not self.is_(i + 1, "(")
        if exported:
            start = i if start == i else start
            i += 1
            after = self.exports(i, start)
            if after > i and not (self.is_(i, "type") and after == i + 1):
                return after
        default = exported and self.is_(i, "default")
        i += default
        while self.is_(i, "@"):
            i = self.expression_of_decorator(i)
        if self.is_(i, "import") and not default and not self.is_(i + 1, "(", "."):
            return self.imports(i + 1)
        at, declared = self.begins[first], False
        while self.is_(i, "declare", "abstract") or self.is_(i, "async") and self.is_(i + 1, "function"):
            if i + 1 >= self.count or self.kinds[i + 1] != "word" or self.fresh[i + 1]:
                break
            declared = declared or self.is_(i, "declare")
            i += 1
        named = self.texts[i + 1] if i + 1 < self.count and self.kinds[i + 1] == "word" else None
        if self.is_(i, "function"):
            name = i + 1 + self.is_(i + 1, "*")
            end = self.function_end(i + 1)
            self.declare(self.texts[name] if name < self.count and self.kinds[name] == "word" else None, at, self.end_of(end), exported, default, True)
            return end
        if self.is_(i, "class"):
            name = named if named not in ("extends", "implements") else None
            body = self.body(i + 1)
            members = self.members(body) if self.is_(body, "{") and not (declared or self.ambient) else {}
            end = self.skip(body) if self.is_(body, "{") else body
            self.declare(name, at, self.last(end), exported, default, members=members)
            return end
        if self.is_(i, "const") and self.is_(i + 1, "enum"):
            i, named = i + 1, self.word(i + 2)
        if self.is_(i, "interface", "enum", "namespace", "module") and named:
            body = self.body(i + 1)
            end = self.skip(body) if self.is_(body, "{") else body
            self.declare(named, at, self.last(end), exported, default)
            return end
        if self.is_(i, "type") and named and self.is_(i + 2, "=", "<"):
            j = self.angles(i + 2) if self.is_(i + 2, "<") else i + 2
            end = self.expression(j + 1)
            self.declare(named, at, self.end_of(end), exported, default)
            return end
        if self.is_(i, "const", "let", "var"):
            found, end = self.variables(i + 1)
            for d in found:
                self.local.setdefault(d.name, []).append(d)
            if exported:
                group = self.group()
                self.later += [(True, d.name, d.start, d.end, (group, at, self.end_of(end))) for d in found]
            return end
        if default:
            end = self.expression(i)
            if end == i + 1 and self.kinds[i] == "word":
                self.listed.append((self.texts[i], "default"))
            elif end > i:
                self.later.append((True, "default", self.begins[i], self.last(end), None))
            return end
        i = max(i, first + 1) if i > first else self.skip(i)
        while i < self.count and self.codes[i] != ";":
            if self.fresh[i] and self.codes[i] in BEGINS and not self.is_(i - 1, ".", "=", "(", ",", "=>"):
                return i
            i = self.skip(i)
        return i

    def run(self) -> list[dict]:
        self.later: list[tuple] = []
        i = 0
        while i < self.count:
            i = i + 1 if self.is_(i, ";") else max(self.statement(i), i + 1)
        for _, name, start, end, more in sorted(self.later, key=lambda x: x[0]):  # functions first
            if isinstance(more, tuple):
                group, first, last = more
                self.symbol(name, start, end, group, first, last)
            else:
                self.symbol(name, start, end, self.group(), members=more)
        for local, given in self.listed:
            found = self.local.get(local)
            if found:
                d = next((d for d in found if d.function), found[0])
                self.symbol(given, d.start, d.end, self.group())
            elif local in self.imported and self.imported[local][1]:
                name, spec = self.imported[local]
                self.link("reexport", spec, name, given)
        for start, end in self.comments:
            if re.match(r"//+\s*@impl\b", self.text[start:end]):
                self.rows.append({"path": self.path, "kind": "tag", "start": self.line(start), "name": self.text[start:end]})
        self.rows.append({"path": self.path, "kind": "file", "name": "module" if self.module else None, "start": 1, "end": len(self.starts)})
        return self.rows


def declarations(files: DataFrame) -> DataFrame:
    """Rows of the declarations of ``files(path, text)``; a table of declarations is returned as it is.

    kind is symbol (name, owner if it is a member, start and end lines, grp shared
    by the names of one statement, content_hash of its text), import (spec; name
    is what is imported, null for the whole file), reexport (spec; name handed on
    as given, both null for a star, name ``*`` for a namespace) or tag (start, its
    comment as name).  The comments and blank lines right above a symbol are its
    lines.  Null and empty texts give no rows; what cannot be read is skipped.
    """
    if "grp" in files.columns:
        return files
    kinds = {"start": pa.int32(), "end": pa.int32(), "grp": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.string())) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) if text for r in Reader(path, text).run()]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    return dealt(files.select("path", F.col("text").cast("string").alias("text"))).mapInArrow(run, SCHEMA)
