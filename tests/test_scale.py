"""What keeps the work spread out and done once, whatever the tables' files look like."""

from weftgraph.graph import Graph, large, placed
from weftgraph.operators import build, extract
from weftgraph.operators.blocks import blocks
from weftgraph.operators.declarations import declarations
from weftgraph.operators.evidence import classify
from weftgraph.operators.resolve import targets
from weftgraph.plans import catalog
from weftgraph.sources.fragments import Fragments
from weftgraph.streaming import classes


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_one_partition_are_parsed_in_many(spark):
    files = spark.createDataFrame([(f"src/o{i}.ts", f"export const a{i} = 1") for i in range(64)], "path string, text string").coalesce(1)
    assert files.rdd.getNumPartitions() == 1
    for rows in (declarations(files), blocks(files, extract.HEADING)):
        parts = [p for p in rows.select("path").rdd.glom().collect() if p]
        assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_code_is_read_once_where_its_imports_are_resolved(spark):
    files = spark.createDataFrame([("src/a.ts", "export * as n from './b'"), ("src/b.ts", "export const b = 1")], "path string, text string")
    found = extract.reexports(files)
    assert "MapInArrow" not in plan(found)  # parsed and stored before it is joined
    assert [(r.path, r.name) for r in found.collect()] == [("src/a.ts", "n")]


def test_classes_of_evidence_broadcast_nothing(spark):
    nodes = spark.createDataFrame([("c", "symbol"), ("c.m", "symbol"), ("R", "req")], "id string, kind string")
    edges = spark.createDataFrame([("c", "c.m", "contains"), ("c", "R", "implements")], "source string, target string, kind string")
    found = classify(Graph(nodes, edges), spark.createDataFrame([("R", "c.m")], "req_id string, node_id string"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("corroborated", "R", "c", None)]


def test_shards_are_not_streamed_four_at_a_time(spark, monkeypatch):
    tables, read = [], classes.read_counts
    monkeypatch.setattr(classes, "read_counts", lambda s, table: tables.append(table) or read(s, table))
    catalog.QUERIES["streamed_classes"](spark, "/root/testdata/sf0.01").count()
    assert spark.read.parquet(tables[0]).select("batch").distinct().count() == 1  # ten shards


def test_levels_are_joined_where_they_lie(spark):
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = placed(spark.range(9).selectExpr("id", "id + 1 AS next").repartition(width, "id"))
    level = placed(spark.range(5).repartition(width, "id"))
    seen = level.union(placed(spark.range(5, 7).repartition(width, "id")))
    found = large(steps).join(large(seen), "id", "anti")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert sorted(r.id for r in found.collect()) == [7, 8]


def test_kept_fragments_are_matched_once(spark, tmp_path):
    """What a build reads of kept fragments is a table, in the first build as in the next: its many readers join nothing."""
    kept, files = Fragments(str(tmp_path / "kept")), spark.createDataFrame([("src/a.ts", "export const a = 1"), ("src/b.ts", "let b")], "path string, text string")
    first = kept.read(files, "declarations", declarations)
    second = kept.read(files.replace("let b", "let c"), "declarations", declarations)
    assert [first[1], second[1]] == [2, 1]
    for rows, _ in (first, second):
        assert "Join" not in plan(rows)
        assert sorted(r.path for r in rows.filter("kind = 'file'").collect()) == ["src/a.ts", "src/b.ts"]


def test_candidates_of_a_specifier_are_made_once(spark):
    specs = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "./c/"), ("src/a.ts", "./none"), ("src/a.ts", "./v")], "path string, spec string")
    # The best candidate of a stage counts: v.tsx is not allowed, so the folder's index is taken.
    files = spark.createDataFrame([(f"src/{p}", "export {}") for p in ("b.ts", "b/index.ts", "c/index.d.ts", "v.tsx", "v/index.ts")], "path string, text string")
    found = targets(specs, files)
    assert plan(found).count("Generate") == 1
    assert {r.spec: r.target for r in found.collect()} == {"./b": "src/b.ts", "./c/": "src/c/index.d.ts", "./v": "src/v/index.ts"}


def test_a_build_broadcasts_no_large_files(spark, monkeypatch):
    setting, seen, stored = "spark.sql.autoBroadcastJoinThreshold", [], build.stored
    monkeypatch.setattr(build, "stored", lambda df: seen.append(spark.conf.get(setting)) or stored(df))
    before = spark.conf.get(setting)
    build.build(spark.createDataFrame([("src/a.ts", "export const a = 1")], "path string, text string"))
    assert set(seen) == {"1m"}
    assert spark.conf.get(setting) == before
