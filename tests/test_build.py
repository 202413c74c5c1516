"""From files to a graph: one small repository with collisions, cycles, repairs and links."""

import pytest
from weftgraph.operators.build import Layout, build, expand_stars, spec_dir_of

SPEC = """---
title: A
graph:
  node_id: doc:A
  depends_on:
    - doc:B
    - doc:missing
  odd: x
---
# T
- REQ-1: one (depends_on: REQ-2, bad id)
- REQ-2: two `(depends_on: REQ-9)` (depends_on: REQ-2)
- SC-1: ignored
- REQ-3: three ( depends_on : REQ-77)
see [b](../b/plan.md) and [x](nope.md) and [y](../../src/notes.md)
"""
FILES = [
    ("specs/a/spec.md", SPEC),
    ("specs/a/plan.md", "# Plan\n- [x] T001 do @impl(REQ-2) [REQ-3]\n"),
    ("specs/b/plan.md", "---\ngraph:\n  node_id: doc:B\n---\n- REQ-1: other\n- REQ-5: five (depends_on: REQ-1)\n"),
    ("src/a.ts", "import { b, c as d } from './b'\nimport * as n from './c'\n// @impl REQ-1, SC-4\nexport function f() {\n  // @impl REQ-2\n}\nexport class K {\n  run() {\n    // @impl b/REQ-1\n  }\n}\n"),
    ("src/b.ts", "export const b = 1\nconst z = 2\nexport { z as y }\n"),
    ("src/c.ts", "export * from './b'\nexport const own = 1\n"),
    ("src/d.ts", "export * from './c'\nexport { b } from './b'\n"),
    ("src/a.test.ts", "import { f } from './a'\nit('[REQ-2] x')\n// req: \"a/REQ-1\" [zz/REQ-4]\n"),
    ("src/notes.md", "out of scope"),
]
EDGES = """
REQ-3 depends_on REQ-77 annotation
REQ-5 depends_on b/REQ-1 annotation
a/REQ-1 depends_on REQ-2 annotation
T001 implements REQ-2 task-tag
T001 verifies REQ-3 task-tag
doc:A contains REQ-2 structural
doc:A contains REQ-3 structural
doc:A contains a/REQ-1 structural
doc:B contains REQ-5 structural
doc:B contains b/REQ-1 structural
doc:a/plan.md contains T001 structural
doc:A depends_on doc:B frontmatter
doc:A depends_on doc:missing frontmatter
doc:a/plan.md derives_from doc:A convention
file:src/a.test.ts verifies REQ-2 code-tag
file:src/a.test.ts verifies a/REQ-1 code-tag
file:src/a.test.ts verifies zz/REQ-4 code-tag
file:src/a.test.ts imports file:src/a.ts ts-import
file:src/a.ts imports file:src/b.ts ts-import
file:src/a.ts imports file:src/c.ts ts-import
file:src/a.ts imports symbol:src/b.ts#b ts-import
file:src/c.ts imports file:src/b.ts ts-import
file:src/d.ts imports file:src/c.ts ts-import
symbol:src/a.ts#K contains symbol:src/a.ts#K.run structural
symbol:src/a.ts#K.run implements b/REQ-1 code-tag
symbol:src/a.ts#f implements REQ-2 code-tag
symbol:src/c.ts#b imports symbol:src/b.ts#b ts-import
symbol:src/c.ts#y imports symbol:src/b.ts#y ts-import
symbol:src/d.ts#b imports symbol:src/b.ts#b ts-import
symbol:src/d.ts#own imports symbol:src/c.ts#own ts-import
symbol:src/d.ts#y imports symbol:src/c.ts#y ts-import
"""
WARNINGS = {
    ("ambiguous-id", "REQ-1", None),
    ("ambiguous-id", "zz/REQ-4", None),
    ("invalid-annotation-id", "bad id", "specs/a/spec.md"),
    ("invalid-relation", "odd", "specs/a/spec.md"),
    ("orphan-doc", "doc:missing", "specs/a/spec.md"),
    ("orphan-edge", "REQ-77", "specs/a/spec.md"),
    ("phantom-import-repaired", "symbol:src/b.ts#c", "src/a.ts"),
    ("self-reference-annotation", "REQ-2", "specs/a/spec.md"),
    ("unresolved-link", "specs/a/nope.md", "specs/a/spec.md"),
    ("out-of-scope-link", "src/notes.md", "specs/a/spec.md"),
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def test_symbol_grain(files):
    graph, warnings = build(files, Layout(ignored=("SC",)))
    got = {f"{r.source} {r.kind} {r.target} {','.join(r.provenances)}" for r in graph.edges.collect()}
    assert got == set(EDGES.strip().splitlines())
    assert {tuple(r) for r in warnings.select("type", "id", "file").collect()} == WARNINGS
    kinds = {}
    for r in graph.nodes.collect():
        kinds.setdefault(r.kind, set()).add(r.id)
    assert kinds["req"] == {"a/REQ-1", "b/REQ-1", "REQ-2", "REQ-3", "REQ-5"} and kinds["doc"] == {"doc:A", "doc:B", "doc:a/plan.md"}
    assert kinds["test"] == {"file:src/a.test.ts"} and kinds["task"] == {"T001"} and len(kinds["file"]) == 4 and len(kinds["symbol"]) == 11


def test_file_grain(files):
    graph, _ = build(files, Layout(ignored=("SC",), grain="file"))
    assert graph.kinds("symbol").isEmpty()
    claims = {(r.source, r.target) for r in graph.edges_of("implements").collect()}
    assert claims == {("file:src/a.ts", "REQ-2"), ("file:src/a.ts", "b/REQ-1"), ("T001", "REQ-2")}


def test_star_exports(spark):
    own = [("leaf", "a"), ("leaf", "default"), ("left", "b"), ("right", "b"), ("shadow", "a"), ("x", "p"), ("y", "q")]
    stars = [("barrel", "leaf"), ("left", "leaf"), ("right", "leaf"), ("diamond", "left"), ("diamond", "right"), ("shadow", "leaf"), ("top", "shadow"), ("x", "y"), ("y", "x"), ("over", "diamond")]
    nodes, edges = expand_stars(spark.createDataFrame(own, "path string, name string"), spark.createDataFrame(stars, "path string, target string"))
    got = {(r.source.split(":")[1], r.target.split(":")[1]) for r in edges.collect()}
    assert got == {("barrel#a", "leaf#a"), ("left#a", "leaf#a"), ("right#a", "leaf#a"), ("top#a", "shadow#a"), ("x#q", "y#q"), ("y#p", "x#p")}
    assert nodes.count() == len(got)


def test_spec_dirs(spark):
    rows = spark.createDataFrame([("specs/a/b/c.md",), ("specs/c.md",), ("docs/x/y.md",), ("other/z/y.md",)], "p string")
    assert [r[0] for r in rows.select(spec_dir_of(rows.p, ("specs", "docs"))).collect()] == ["a", "specs", "x", "z"]


def test_evidence_and_metadata(spark):
    files = spark.createDataFrame(
        [
            ("specs/a/spec.md", "---\ntitle: A\nstatus: draft\nowner: ann\n---\n- REQ-1: one\n- REQ-2: two\n"),
            ("src/a.ts", "// @impl REQ-1\nexport const a = 1\n"), ("src/p/package.json", '{"main": "m.js"}'), ("src/p/m.ts", "export const m = 1\n"),
            ("src/b.ts", "import { m } from './p'\nimport './plain'\n"), ("src/plain.ts", "let x\n"), ("src/node_modules/q/i.ts", "export {}"),
        ],
        "path string, text string",
    )
    seen = spark.createDataFrame([("REQ-1", "symbol:src/a.ts#a"), ("REQ-2", "symbol:src/a.ts#gone"), ("REQ-2", "symbol:src/none.ts#x")], "req_id string, node_id string")
    graph, warnings = build(files, evidence=seen)
    edges = {(r.source, r.target, r.kind): r.provenances for r in graph.edges.collect()}
    assert edges["symbol:src/a.ts#a", "REQ-1", "implements"] == ["code-tag", "coverage"] and edges["REQ-2", "file:src/a.ts", "exercises"] == ["coverage"]
    assert [e for e in edges if e[2] == "imports"] == [("file:src/b.ts", "symbol:src/p/m.ts#m", "imports")]
    doc = graph.kinds("doc").first()
    assert doc.metadata == {"title": "A", "status": "draft", "owner": "ann"} and doc.label == "A"
    told = {(r.type, r.id, r.file) for r in warnings.collect()}
    assert ("unresolved-import", "./plain", "src/b.ts") in told and ("node-modules-in-scan", "node_modules", "src/node_modules/q/i.ts") in told
