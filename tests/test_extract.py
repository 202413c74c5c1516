"""Text extraction, rewriting and shard streaming on small authored inputs."""

import json

from pyspark.sql import functions as F
from weftgraph.operators import extract, rewrite
from weftgraph.sources import shards, text
from weftgraph.streaming import classes
from weftgraph.streaming import shards as streaming

SPEC = """---
title: "Sign in"
owner: ann
graph:
  node_id: doc:auth
  depends_on: [doc:a, 'doc:b']
  derives_from:
    - doc:c
---
# Auth
- FR-1: one (depends_on: FR-2)
- prose FR-9: none
## Requirement 3: Third ##
Body (derives_from: X-1)
### Detail
more
## Requirement 4 is prose
See [x](./other.md#part), `[y](code.md)`, ![z](img.md) and [w](https://e.org/w.md).
"""


def frame(spark, rows, schema="path string, text string"):
    return spark.createDataFrame(rows, schema)


def test_markdown(spark):
    files = frame(spark, [("specs/a/spec.md", SPEC), ("specs/a/empty.md", ""), ("specs/a/null.md", None)])
    found = {r.id: r for r in extract.requirements(files).collect()}
    assert set(found) == {"FR-1", "Requirement-3"} and found["Requirement-3"].label == "Requirement 3: Third"
    sha = lambda t: spark.range(1).select(F.substring(F.sha2(F.lit(t), 256), 1, 16)).first()[0]
    assert found["FR-1"].content_hash == sha("FR-1: one")
    assert found["Requirement-3"].content_hash == sha("## Requirement 3: Third ##\nBody\n### Detail\nmore")
    head = extract.front_matter(files).collect()
    assert len(head) == 1 and head[0].node_id == "doc:auth" and head[0].title == "Sign in" and head[0].owner == "ann" and head[0].status is None
    assert head[0].depends_on == ["doc:a", "doc:b"] and head[0].derives_from == ["doc:c"]
    assert [r.target for r in extract.inline_links(files).collect()] == ["specs/a/other.md"]


def test_tasks(spark):
    body = "# Tasks\n- [ ] T001 do @impl(src/a.ts, src/b.ts) [FR-1]\n- [x] 2.1 kiro\n  - _Requirements: 1.1, 3.2_\n## Next\n- [ns/FR-2] loose\n"
    nodes, edges = extract.tasks(frame(spark, [("s/tasks.md", body), ("s/notes.md", body)]))
    assert {(r.id, r.convention) for r in nodes.collect()} == {("T001", "spec-kit"), ("2.1", "kiro")}
    assert {(r.source, r.kind, r.target, r.target_space) for r in edges.collect()} == {
        ("T001", "implements", "src/a.ts", None), ("T001", "implements", "src/b.ts", None), ("T001", "verifies", "FR-1", None),
        ("2.1", "verifies", "Requirement-1", "requirement"), ("2.1", "verifies", "Requirement-3", "requirement"),
    }


def test_code(spark):
    files = frame(spark, [("src/a/x.ts", "import y from '../b'\nexport { z } from './z.js'\n// @impl A-1,ns/B-2\nexport default function () {}\n"), ("src/b/index.ts", ""), ("src/a/z.ts", "import 'react'")])
    assert {(r.source, r.target) for r in extract.imports(files).collect()} == {("file:src/a/x.ts", "file:src/b/index.ts"), ("file:src/a/x.ts", "file:src/a/z.ts")}
    assert {(r.line, r.req_id) for r in extract.implementation_tags(files).collect()} == {(3, "A-1"), (3, "ns/B-2")}
    assert [r.id for r in extract.exported_symbols(files).collect()] == ["symbol:src/a/x.ts#default"]


def test_rename(spark):
    files = frame(spark, [("a.md", "- FR-1: x (depends_on: FR-2, FR-1)\nFR-1 in prose, [FR-1], FR-10\n"), ("a.ts", "// @impl FR-1, FR-10\nreq: 'FR-1'\n"), ("b", None)])
    out = {r.path: r.text for r in rewrite.rename_in_text(files, "FR-1", "FR-$9").collect()}
    assert out["a.md"] == "- FR-$9: x (depends_on: FR-2, FR-$9)\nFR-1 in prose, [FR-1], FR-10\n"
    assert out["a.ts"] == "// @impl FR-$9, FR-10\nreq: 'FR-$9'\n" and out["b"] is None


def test_files_and_pools(spark, tmp_path):
    for name in ("src/a.ts", "src/a.test.ts", "src/gen/b.ts", "doc.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("﻿x", encoding="utf-8")
    files = text.text_files(spark, str(tmp_path), "*.ts")
    assert {(r.path, r.text) for r in files.collect()} == {("src/a.ts", "x"), ("src/a.test.ts", "x"), ("src/gen/b.ts", "x")}
    pool = text.code_files(files, ["src/**/*.ts", "!src/gen/**"], ["**/*.test.ts"])
    assert {(r.path, r.is_test) for r in pool.collect()} == {("src/a.ts", False), ("src/a.test.ts", True)}


def test_shard_stream(spark, tmp_path):
    test = {"kind": "test", "testName": "[A-1] t", "testFile": "t", "passed": True, "hits": [{"file": "a", "fn": "f"}], "hashes": {"a": "h"}}
    for i in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.jsonl").write_text("\n".join([json.dumps({"kind": "meta", "schemaVersion": 1}), json.dumps(test), "", "[]", "{"]))
        streaming.write_generation(streaming.stream_shards(spark, f"{tmp_path}/in"), f"{tmp_path}/out", "g1", f"{tmp_path}/check").awaitTermination()
    records = streaming.read_generation(spark, f"{tmp_path}/out", "g1")
    tests, skipped, seen = shards.normalise(records)
    assert tests.count() == 1 and skipped.count() == 0 and seen.first().asDict() == {"corrupted": 4, "shards": 2, "unknown_schema": 0}
    out = shards.ingest(tests, frame(spark, [("a", "f", "symbol:a#f"), ("a", "g", "1"), ("a", "g", "2")], "path string, name string, id string"), frame(spark, [("a",)], "path string"))
    assert [tuple(r) for r in out["evidence"].collect()] == [("A-1", "symbol:a#f", "symbol")]
    assert [tuple(r) for r in out["hashes"].collect()] == [("symbol:a#f", "h")] and out["dangling"].first()[0] == 0


def test_counts_over_two_runs(spark, tmp_path):
    """Copies of a shard, and shards that come later, change the counts as a batch over all of them would."""
    line = lambda req, fn: json.dumps({"kind": "test", "testName": f"[{req}] t", "testFile": "t", "passed": True, "hits": [{"file": "a", "fn": fn}], "hashes": {}})
    meta = json.dumps({"kind": "meta", "schemaVersion": 1})
    other = json.dumps({"kind": "meta", "schemaVersion": 2})
    symbols = frame(spark, [("a", "f", "symbol:a#f")], "path string, name string, id string")
    files = frame(spark, [("a",)], "path string")
    (tmp_path / "in").mkdir()
    runs = [[(meta, line("A-1", "f")), (meta, line("A-1", "f"))], [(meta, line("A-2", "f")), (meta, line("A-1", "g")), (other, line("A-9", "f"))]]
    for n, (shards_, want) in enumerate(zip(runs, [{("symbol:a#f", 1, "exclusive", "A-1")}, {("symbol:a#f", 2, "shared", None), ("file:a", 1, "exclusive", "A-1")}], strict=True)):
        for i, text_ in enumerate(shards_):
            (tmp_path / f"in/{n}{i}.jsonl").write_text("\n".join(text_))
        counts = classes.count_requirements(classes.stream_whole_shards(spark, f"{tmp_path}/in", 1), symbols, files, "g")
        classes.write_counts(counts, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        got = classes.node_classes(classes.read_counts(spark, f"{tmp_path}/out")).collect()
        assert {(r.node_id, r.n_reqs, r["class"], r.req_id) for r in got} == want
