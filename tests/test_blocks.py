"""Markdown blocks, declarations, star exports, mentions and kept fragments on small authored inputs and against brute force."""

import hashlib
import random
import re
import time

import pytest
from weftgraph.functions.ids import index_mentions
from weftgraph.graph import Levels
from weftgraph.operators import extract
from weftgraph.operators.blocks import Fold, plain
from weftgraph.operators.build import build
from weftgraph.operators.declarations import Reader
from weftgraph.operators.extract import HEADING, Convention
from weftgraph.operators.stars import providers
from weftgraph.sources import results
from weftgraph.sources.fragments import Fragments

DOC = """---
- FR-0: matter
---
# Title `c` *em*

1. REQ-3: ordered **bold** (depends_on: A-1)
   continued line `x(depends_on: B-2)`
   - nested FR-1: no
   - **FR-2**: nested yes

     second para (depends_on: C-3)
2) REQ-4: other list
lazy line

> - FR-9: quoted (depends_on: X-1)

```
- FR-7: code
```
    - FR-8: indented code
<!--
- FR-6: comment
-->
- [x] T001 do @impl(a.ts)
  @impl(b.ts) [FR-1]
  - [ ] T002 sub [FR-2]
    - deep @impl(c.ts)
  - plain [FR-3]
### Requirement 3: Third ##

first (derives_from: X-1)
middle (derives_from: Y-1)
last `code` (depends_on: Z-1)

rest (depends_on: Q-1)
"""


def short(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def frame(spark, rows, schema="path string, text string"):
    return spark.createDataFrame(rows, schema)


def test_requirements_in_nested_blocks(spark):
    files = frame(spark, [("specs/a/tasks.md", DOC), ("specs/a/empty.md", ""), ("specs/a/null.md", None)])
    found = {r.id: r for r in extract.requirements(files).collect()}
    assert set(found) == {"REQ-3", "REQ-4", "FR-2", "FR-9", "Requirement-3"}
    assert found["REQ-3"].label == "REQ-3: ordered bold (depends_on: A-1)\ncontinued line x(depends_on: B-2)"
    assert found["REQ-3"].content_hash == short("REQ-3: ordered bold\ncontinued line x nested FR-1: noFR-2: nested yessecond para")
    assert found["REQ-4"].label == "REQ-4: other list\nlazy line" and found["REQ-4"].line == 12
    assert found["Requirement-3"].content_hash == short("### Requirement 3: Third ##\n\nfirst\nmiddle\nlast `code`\n\nrest (depends_on: Q-1)\n")
    noted = {(r.source, r.kind, r.target) for r in extract.annotations(files).collect()}
    assert noted == {("REQ-3", "depends_on", "A-1"), ("Requirement-3", "derives_from", "X-1"), ("Requirement-3", "depends_on", "Z-1")}


def test_tasks_have_their_own_subtree(spark):
    many = "- [ ] 9 long\n  - _Requirements: " + ", ".join(f"{i}.1" for i in range(1, 150)) + "_\n"
    nodes, edges = extract.tasks(frame(spark, [("s/tasks.md", DOC + many), ("s/notes.md", DOC)]))
    assert {(r.id, r.convention) for r in nodes.collect()} == {("T001", "spec-kit"), ("T002", "spec-kit"), ("9", "kiro")}
    found = {(r.source, r.kind, r.target) for r in edges.collect()}
    assert {e for e in found if e[0] != "9"} == {
        ("T001", "implements", "a.ts"), ("T001", "implements", "b.ts"), ("T001", "verifies", "FR-1"), ("T001", "verifies", "FR-3"), ("T002", "verifies", "FR-2"), ("T002", "implements", "c.ts"),
    }
    assert {e[2] for e in found if e[0] == "9"} == {f"Requirement-{i}" for i in range(1, 150)}


def test_patterns_are_arguments(spark):
    files = frame(spark, [("x/todo.md", "- #12 wash {for A-1, B-2}\n## Story S-7 of\nbody (depends_on: A-1)\n")])
    own = Convention("own", ("todo",), r"^#(\d+)\b", r"\{for ([^}]*)\}")
    nodes, edges = extract.tasks(files, (own, *extract.CONVENTIONS))
    assert [(r.id, r.convention) for r in nodes.collect()] == [("12", "own")] and {r.target for r in edges.collect()} == {"A-1", "B-2"}
    heading = r"^Story (\S+)"
    assert [r.id for r in extract.requirements(files, heading=heading).collect()] == ["S-7"]
    assert [(r.source, r.target) for r in extract.annotations(files, heading=heading).collect()] == [("S-7", "A-1")]


def test_plain_text():
    assert plain("**a** _b_ `c *d*` [e](f.md) ![g](h) \\*i\\* j_k_l &amp; <http://x.y> [FR-1] [m][n] [o]", frozenset({"n"})) == "a b c *d* e g *i* j_k_l & http://x.y [FR-1] m [o]"
    assert plain("a `b` <!-- c --> d", bare=True) == "a   d"


def test_document_hash_ignores_ticks_of_items():
    text = "- [x] a\r\n  * [X] b\n- [x]c\n1. [x] d\n[x] e\n```\n- [x] f\n```"
    row = Fold("a.md", text, HEADING).run()[-1]
    assert row["kind"] == "document" and row["text"] == short("- [ ] a\n  * [ ] b\n- [x]c\n1. [ ] d\n[x] e\n```\n- [x] f\n```")


def test_folds_are_linear():
    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        Fold("a.md", "\n".join(f"- FR-{i}: item **b** `c`\n  more" if i % 3 else f"## Head {i}" for i in range(n)), HEADING).run()
        Reader("a.ts", "\n".join(f"export const a{i} = {{ b: `${{{i}}}` }} // c" for i in range(n))).run()
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]  # four times the lines


CODE = """import def, { a as b, type C } from './m'
const dyn = import('./dyn') // import './ghost'
/* export const ghost = 1
import './ghost2' */
const s = "export const no = 1; // @impl NO-1", re = /[/"'`]+export/g, q = `t ${ `n ${ {a: 1}.a }` } export const no2 = 1
// @impl NO-2`
// @impl A-1, ns/B-2

export const { p, q: r, ...rest } = obj, [m1, [m2 = 3]] = arr, v: Map<string, number> = new Map<string, number>(), w = 1
export function over(a: string): void
export function over(a: any): { x: 1 } | undefined {
  // @impl IN-1
}
@dec({ a: 1 }) export abstract class K<T = {}> extends Base<{ z: 1 }> implements I {
  static #p = 1
  x = 5
  static { init() }
  arrow = async (a: number): Promise<void> => { a }
  // @impl M-1
  run<T>(a: T): { b: 1 } {
    if (a) { other() }
  }
  'quoted'() {}
  [Symbol.iterator]() {}
}
export type U<T> =
  | { a: T }
  | "b"
declare module "amb" { export const hidden: 1 }
function local() {}
export {
  local as renamed, // comment, two
  b as handed,
}
export { x1, default as d2 } from './re'
export * from './star'
export * as nsx from './nsx'
export default local
export const fn = () => {
  return 1
}
"""


def test_declarations():
    rows = Reader("src/a.ts", CODE).run()
    symbols = {r["name"]: (r["start"], r["end"]) for r in rows if r["kind"] == "symbol"}
    assert set(symbols) == {"p", "r", "rest", "m1", "m2", "v", "w", "over", "K", "K.arrow", "K.run", "U", "renamed", "default", "fn"}
    assert symbols["p"] == symbols["w"] == (7, 9) and symbols["over"] == (10, 10) and symbols["K.run"] == (19, 22) and symbols["U"] == (26, 28) and symbols["fn"] == (39, 41)
    hashed = {r["name"]: r["content_hash"] for r in rows if r["kind"] == "symbol"}
    assert hashed["r"] == short("q: r") and hashed["m2"] == short("m2 = 3") and hashed["w"] == short("w = 1") and hashed["default"] == hashed["renamed"] == short("function local() {}")
    links = {(r["kind"], r["spec"], r["name"], r["given"]) for r in rows if r["kind"] in ("import", "reexport")}
    assert links == {
        ("import", "./m", "default", None), ("import", "./m", "a", None), ("import", "./m", "C", None), ("reexport", "./re", "x1", "x1"), ("reexport", "./re", "default", "d2"),
        ("reexport", "./star", None, None), ("reexport", "./nsx", "*", "nsx"), ("reexport", "./m", "a", "handed"),
    }
    assert [r["start"] for r in rows if r["kind"] == "tag"] == [7, 12, 19]


@pytest.mark.parametrize("text", ["", "`${", "export", "export {", "export default", "class {", "export class", "import", "@", "export const {", "((((", "}}}", "export const a = <", "function", "export function (", "type x", "/* ", "'", "export *", "export * as", "import {a", "interface", "@a.b(", "export const enum", "const {...${*/:", "const {a:", "const [...", "export const {...}", "type extends <"])
def test_broken_code_is_no_error(text):
    assert Reader("a.ts", text).run()[-1]["kind"] == "file"


def test_tokens_lie_where_their_text_is():
    read = Reader("a.ts", "const t = `x${ {a: 1} }y` / 2 // c\nconst r = /[/]{/g, f = (a, [b]) => 'z'\n")
    assert len({len(x) for x in (read.kinds, read.texts, read.begins, read.ends, read.fresh, read.closes)}) == 1 and read.count == len(read.kinds)
    assert all(read.text[a:b] == t for k, t, a, b in zip(read.kinds, read.texts, read.begins, read.ends, strict=True) if k != "string" or t != "`")
    assert [read.texts[i] + read.texts[j] for i, j in enumerate(read.closes) if j >= 0] == ["{}", "()", "[]"]
    assert [t for t, fresh in zip(read.texts, read.fresh, strict=True) if fresh] == ["const", "const"] and read.codes[read.texts.index("/[/]{/g")] == ""


def ways(name, at, own, steps, seen=()):
    """All ways without repeats from a file to a declaration, for tests."""
    if name in own.get(at, ()):
        return 1
    return sum(ways(name, t, own, steps, (*seen, at)) for t in steps.get(at, ()) if t not in seen and t != at)


def test_star_exports_equal_brute_force(spark):
    draw = random.Random(1)
    symbols, stars, want = [], [], set()
    for g in range(60):
        n = draw.randrange(2, 8)
        files = [f"g{g}/f{i}" for i in range(n)]
        own = {f: {x for x in ("a", "b", "default") if draw.random() < 0.25} for f in files}
        steps = {f: {t for t in files if draw.random() < 0.3} for f in files}
        if g % 3 == 0:  # a chain walked both ways
            steps = {f: {files[j] for j in (i - 1, i + 1) if 0 <= j < n} for i, f in enumerate(files)}
            own = {f: {"a"} if i == 0 else set() for i, f in enumerate(files)}
        symbols += [(f, x) for f in files for x in own[f]]
        stars += [(f, t) for f in files for t in steps[f]]
        for f in files:
            for x in ("a", "b"):
                if x not in own[f] and ways(x, f, own, steps) == 1:
                    want.add((f, x, next(t for t in steps[f] if t != f and ways(x, t, own, steps, (f,)) == 1)))
    got = providers(frame(spark, symbols, "path string, name string"), frame(spark, stars, "path string, target string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_cut_chains_of_star_exports_equal_brute_force(spark):
    """Names that several files declare, ways longer than the chains that are kept, and files that nobody exports."""
    draw = random.Random(3)
    symbols, stars, want = [], [], set()
    for g in range(30):
        n = draw.randrange(4, 9)
        files = [f"g{g}/f{i}" for i in range(n)]
        own = {f: {"a"} if i == 0 else {x for x in ("a", "b") if draw.random() < 0.1} for i, f in enumerate(files)}
        steps = {f: {files[j] for j in {i - 1, *(draw.randrange(i, n) for _ in range(draw.randrange(3)))} if 0 <= j} for i, f in enumerate(files)}
        symbols += [(f, x) for f in files for x in own[f]]
        stars += [(f, t) for f in files for t in steps[f]]
        want |= {(f, x, next(t for t in steps[f] if t != f and ways(x, t, own, steps, (f,)) == 1)) for f in files for x in ("a", "b") if x not in own[f] and ways(x, f, own, steps) == 1}
    given = frame(spark, symbols, "path string, name string"), frame(spark, stars, "path string, target string")
    assert len(want) > 60
    for most in (2, 3):
        assert sorted(tuple(r) for r in providers(*given, most=most).collect()) == sorted(want)


def test_star_exports_are_settled_in_as_many_rounds_as_they_are_deep(spark, monkeypatch):
    """Ten files that export each other both ways: each is the only way out of all that follow it."""
    rounds, add = [], Levels.add
    monkeypatch.setattr(Levels, "add", lambda self, df: rounds.append(1) or add(self, df))
    stars = [(f"f{i}", f"f{j}") for i in range(10) for j in (i - 1, i + 1) if 0 <= j < 10]
    got = providers(frame(spark, [("f0", "a")], "path string, name string"), frame(spark, stars, "path string, target string"))
    assert sorted(tuple(r) for r in got.collect()) == [(f"f{i}", "a", f"f{i - 1}") for i in range(1, 10)]
    assert len(rounds) <= 14


def test_mentions_by_index(spark):
    draw = random.Random(2)
    ids = ["REQ-1", "REQ-10", "a/REQ-1", "ns/A-2", "-X-1", "X-1-", "(Y)", "é-1", "doc:a.md", "_Z", "...", "A b"]
    pieces = [*ids, "REQ", "-", "1", " ", "é", "_", "x", ".", "\n", "[", "(", ")", "a", "/"]
    texts = [(i, "".join(draw.choice(pieces) for _ in range(draw.randrange(12)))) for i in range(300)] + [(900, None), (901, "")]
    want = {(i, x) for i, t in texts for x in ids if t and x != "..." and re.search(rf"(?<![A-Za-z0-9_]){re.escape(x)}(?![A-Za-z0-9_])", t)}
    got = index_mentions(frame(spark, texts, "k int, text string"), frame(spark, [(x,) for x in ids], "id string"), "k", "id").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_second_build_reads_changed_files_only(spark, tmp_path):
    files = [("specs/a/spec.md", "- REQ-1: one\n- REQ-2: two (depends_on: REQ-1)\n"), ("specs/b/x.md", "- REQ-3: three\n"), ("src/a.ts", "// @impl REQ-1\nexport const a = 1\n"), ("src/b.ts", "export * from './a'\n"), ("src/c.ts", "x()\n"), ("src/d.ts", "")]
    kept = Fragments(str(tmp_path / "kept"))
    rows = lambda g: (sorted(map(repr, g.nodes.collect())), sorted(map(repr, g.edges.collect())))
    assert rows(build(frame(spark, files), kept=kept)[0]) == rows(build(frame(spark, files))[0])
    changed = [(p, t.replace("one", "uno").replace("= 1", "= 2")) for p, t in files]
    assert rows(build(frame(spark, changed), kept=kept)[0]) == rows(build(frame(spark, changed))[0])
    count = lambda name, g: kept.table(spark, name).filter(f"generation = {g} and kind in ('document', 'file')").count()
    assert [count("blocks", 0), count("declarations", 0), count("blocks", 1), count("declarations", 1)] == [2, 3, 1, 1]
    # Going back costs nothing; what is gone is pruned.
    assert kept.read(frame(spark, [f for f in files if f[0].startswith("specs")]), "blocks", lambda f: extract.blocks(f, HEADING), HEADING)[1] == 0
    kept.prune(frame(spark, files[:1]), "blocks", str(tmp_path / "less"))
    assert {r.path for r in Fragments(str(tmp_path / "less")).table(spark, "blocks").select("path").collect()} == {"specs/a/spec.md"}


def test_suites_of_any_depth(spark):
    deep = "<testcase name='[REQ-1] t'/><testcase name='u'><failure/></testcase>"
    for i in range(10):
        deep = f'<testsuite name="s{i}{" [ns/REQ-2]" if i == 3 else ""}">{deep}</testsuite>'
    reports = [f"<?xml version='1.0'?><testsuites>{deep}</testsuites>", "<testsuites><testsuite>", None, "", "<testsuite name='[A-1]'><testcase name='v'><![CDATA[<failure/>]]></testcase></testsuite>"]
    got = results.junit_results(frame(spark, [(r,) for r in reports], "text string")).collect()
    assert sorted(map(tuple, got)) == [("A-1", "v", True), ("REQ-1", "[REQ-1] t", True), ("ns/REQ-2", "u", False)]
