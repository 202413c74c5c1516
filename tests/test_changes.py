"""Reports with nested suites and CDATA, rewriting under masks, split and merge of definitions, and lock files."""

import pytest
from weftgraph.graph import LOCK_SCHEMA
from weftgraph.operators import extract, rewrite
from weftgraph.sources import lock, results, shards

XML = """<?xml version="1.0"?>
<testsuites><testsuite name="[REQ-1] outer"><testcase name="a"/><testsuite name="inner"><testcase name="b"><failure/></testcase>
<testcase name="[REQ-2] c"><system-out><![CDATA[<failure/> </testcase>]]></system-out></testcase></testsuite>
<testcase name="d"><skipped message="x"/></testcase></testsuite></testsuites>"""


def test_junit(spark):
    reports = spark.createDataFrame([(XML,), ("<testsuite name='[x/REQ-3]'><testcase name='e'><error>boom</error></testcase></testsuite>",), ("<broken",)], "text string")
    got = {tuple(r) for r in results.read_results(reports).collect()}
    assert got == {("REQ-1", "a", True), ("REQ-1", "b", False), ("REQ-2", "[REQ-2] c", True), ("REQ-1", "d", False), ("x/REQ-3", "e", False)}


def test_load_results(spark, tmp_path):
    (tmp_path / "good.xml").write_text(XML)
    (tmp_path / "bad.json").write_text("{ not json")
    (tmp_path / "none.xml").write_text("<testsuite name='x'><testcase name='y'/></testsuite>")
    found, told = results.load_results(spark, [f"{tmp_path}/*.xml", f"{tmp_path}/bad.json", f"{tmp_path}/gone*.json"])
    assert found.count() == 4
    assert sorted((r.type, r.id.split("/")[-1]) for r in told.collect()) == [("malformed", "bad.json"), ("no-match", "gone*.json"), ("no-results", "none.xml")]


SPEC = """---
graph:
  node_id: REQ-1
  depends_on: [REQ-1, "REQ-12"]
  derives_from:
    - REQ-1
---
- REQ-1: one (depends_on: REQ-1, REQ-12, REQ-1) `(depends_on: REQ-1)` <!-- (depends_on: REQ-1) --> REQ-1
> - REQ-1: quoted
```
- REQ-1: fenced
```
REQ-1 in prose"""
AFTER = """---
graph:
  node_id: REQ-9
  depends_on: [REQ-9, "REQ-12"]
  derives_from:
    - REQ-9
---
- REQ-9: one (depends_on: REQ-9, REQ-12, REQ-9) `(depends_on: REQ-1)` <!-- (depends_on: REQ-1) --> REQ-1
> - REQ-1: quoted
```
- REQ-1: fenced
```
REQ-1 in prose"""


def test_rename(spark):
    many = ", ".join(["REQ-1"] * 400)
    rows = [
        ("a.md", SPEC),
        ("a.ts", f'const s = "// @impl REQ-1"\n// @impl {many}\nit("[REQ-1] [a/REQ-1]") // req: "REQ-1"\nREQ-1'),
        ("b.md", "## Requirement 3: x\n## Requirement 31\n- Requirement-3 y"),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    out = {r.path: (r.text, r.n_changes) for r in rewrite.rename_in_text(files, "REQ-1", "REQ-9").collect()}
    assert out["a.md"] == (AFTER, 4) and out["b.md"][1] == 0
    assert out["a.ts"] == (rows[1][1].replace(many, many.replace("1", "9")).replace('[REQ-1] [a', '[REQ-9] [a').replace('req: "REQ-1"', 'req: "REQ-9"'), 2)
    assert {r.path: r.text for r in rewrite.rename_in_text(files, "Requirement-3", "Requirement-4").collect()}["b.md"].startswith("## Requirement 4: x\n## Requirement 31\n")


def test_split_and_merge(spark):
    todo = "(TODO: describe this requirement)"
    rows = [
        ("a.md", "---\r\ngraph:\r\n  depends_on: [A-1, B-2]\r\n---\r\n- A-1: x\r\n```\r\n- A-1: x\r\n```\r\n- B-2: y"),
        ("b.md", "- A-1: again\n"), ("c.md", "# none\r- A-10: z"), ("d.txt", "- A-1: text"), ("e.md", None), ("f.md", ""), ("g.md", "### Requirement 3: x ##\nbody"),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    out = {r.path: r.text for r in rewrite.split_definition(files, "A-1", ["A-3", "A-4"]).collect()}
    assert out["a.md"] == f"---\r\ngraph:\r\n  depends_on: [A-3, A-4, B-2]\r\n---\r\n```\r\n- A-1: x\r\n```\r\n- B-2: y\r\n- A-3: {todo}\r\n- A-4: {todo}"
    assert out["b.md"] == f"\n- A-3: {todo}\n- A-4: {todo}"
    assert {p: out[p] for p in "c.md d.txt e.md f.md".split()} == {p: t for p, t in rows if p in "c.md d.txt e.md f.md".split()}
    out = {r.path: r.text for r in rewrite.merge_definitions(files, ["A-1", "B-2", "Requirement-3"], "C-1").collect()}
    assert out["a.md"] == f"---\r\ngraph:\r\n  depends_on: [C-1, C-1]\r\n---\r\n```\r\n- A-1: x\r\n```\r\n- C-1: {todo}"
    assert out["b.md"] == f"\n- C-1: {todo}" and out["g.md"] == f"body\n- C-1: {todo}"
    assert {r.path: r.text for r in rewrite.merge_definitions(files, ["A-1"], "B-2", exists=True).collect()}["b.md"] == ""


def test_rename_keeps_every_other_byte(spark):
    rows = [("a.md", "x\r\n- A-1: y\r\n\r\nz \r\n"), ("b.md", "- A-1: y\rz\n\n"), ("c.json", '"[A-1]"'), ("d.tsx", "// @impl A-1\r\n"), ("e.md", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    out = {r.path: (r.text, r.n_changes) for r in rewrite.rename_in_text(files, "A-1", "A-2").collect()}
    assert out == {p: (t and (t if p == "c.json" else t.replace("A-1", "A-2")), int(p not in ("c.json", "e.md"))) for p, t in rows}
    assert {tuple(r) for r in rewrite.rename_changes(files, "A-1", "A-2").collect()} == {("a.md", 2, "- A-1: y", "- A-2: y"), ("b.md", 1, "- A-1: y", "- A-2: y"), ("d.tsx", 1, "// @impl A-1", "// @impl A-2")}


def test_lock_files(spark, tmp_path):
    folder = f"{tmp_path}/lock"
    assert lock.read_lock(spark, folder).count() == 0
    rows = [("A", "s.md", "h", ["f"], None, None, [("B", ["annotation"])], "t"), ("B", None, 'q"\\', None, None, None, None, "t")]
    frame = spark.createDataFrame(rows, LOCK_SCHEMA)
    assert [lock.write_lock(frame.filter("id = 'A'"), folder), lock.write_lock(frame, folder)] == [0, 1]
    assert sorted(lock.read_lock(spark, folder).collect()) == sorted(frame.collect()) and lock.read_lock(spark, folder, 0).count() == 1
    with pytest.raises(ValueError):
        lock.write_lock(spark.createDataFrame([("_meta", *rows[0][1:])], LOCK_SCHEMA), folder)
    texts = ['{"_meta":{"schemaVersion":1},"A":{"specFile":"s","contentHash":"h"}}', '{"A":{"contentHash":"h"}}', '{"_meta":{"schemaVersion":1.5}}', '{"_meta":{"schemaVersion":7}}', "[1]", "{"]
    entries, told = lock.parse_lock(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted((r.id, r.spec_file or "") for r in entries.collect()) == [("A", ""), ("A", "s")]
    assert sorted(tuple(r) for r in told.collect()) == sorted([(1, "ok"), (0, "ok"), (0, "bad-version"), (7, "newer"), (0, "malformed"), (0, "malformed")])


def test_shard_presence(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}\n")
    assert shards.has_shards(spark, f"{tmp_path}/*.jsonl") and not shards.has_shards(spark, f"{tmp_path}/*.none")
    paths = spark.createDataFrame([("../x.ts",), ("/x.ts",), ("a/node_modules/b.ts",), ("my_node_modules/b.ts",), ("a.test.ts",), ("a.ts",)], "p string")
    assert [r[0] for r in paths.select(shards.is_excluded(paths.p)).collect()] == [True, True, True, False, True, False]
    assert {k: v.count() for k, v in shards.empty_trace(spark).items()} == {"evidence": 0, "tests": 0, "hashes": 0, "dangling": 1}
