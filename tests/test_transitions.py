"""Steps of a reach: which edges are joined at all."""

import random

from pyspark.sql import functions as F
from weftgraph.graph import EDGE_SCHEMA, Graph
from weftgraph.operators import traverse
from weftgraph.plans import catalog


def test_structure_and_claims_meet_no_node(spark):
    nodes = spark.sql("select * from values ('doc:a', 'doc', 'a.md'), ('REQ-1', 'req', 'a.md'), ('T1', 'task', 'a.md') as t(id, kind, file_path)")
    edges = spark.sql("select *, cast(null as string) as target_space from values ('doc:a', 'REQ-1', 'contains', array('structural')), ('T1', 'REQ-1', 'implements', array('task-tag')) as t(source, target, kind, provenances)")
    steps = traverse.transitions(Graph(nodes, edges), 2)
    assert "Join" not in steps._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in steps.collect()} == {("doc:a", "REQ-1", False, 2, 2), ("T1", "REQ-1", False, 2, 2), ("REQ-1", "T1", False, 2, 2)}


def test_what_an_edge_meets(spark):
    nodes = spark.createDataFrame([("file:t", "test", "t"), ("file:a", "file", "a"), ("REQ-1", "req", "s"), ("REQ-2", "req", "s")], "id string, kind string, file_path string")
    rows = [("file:t", "REQ-1", "verifies"), ("file:t", "REQ-2", "verifies"), ("file:a", "REQ-1", "implements"), ("file:t", "file:a", "imports"), ("REQ-1", "file:a", "exercises"), ("REQ-2", "file:a", "exercises"), ("REQ-2", "file:t", "exercises")]
    edges = spark.createDataFrame([(*r, ["x"], None) for r in rows], EDGE_SCHEMA)
    stale = spark.createDataFrame([("file:t",), ("REQ-1",)], "id string")
    got = {(r.from_id, r.to_id, r.needs_hit): (r.from_high, r.from_low) for r in traverse.transitions(Graph(nodes, edges), 2, stale).collect()}
    assert got == {
        ("file:t", "REQ-1", True): (2, None), ("REQ-1", "file:t", False): (1, 1), ("file:t", "REQ-2", True): (2, 0), ("REQ-2", "file:t", False): (1, 1),
        ("file:a", "REQ-1", False): (2, 2), ("REQ-1", "file:a", False): (2, 2), ("file:t", "file:a", False): (2, None), ("file:a", "file:t", False): (1, 1),
        ("REQ-2", "file:a", False): (0, 0), ("file:a", "REQ-2", False): (0, 0),
    }


def test_symbols_that_no_edge_touches_are_in_no_round(spark, monkeypatch):
    rows = [("file:a", "file", "a"), ("symbol:a#x", "symbol", "a"), ("symbol:a#y", "symbol", "a"), ("odd", "symbol", "a"), ("file:b", "file", "b"), ("symbol:b#z", "symbol", "b"), ("symbol:b#w", "symbol", "b")]
    edges = spark.createDataFrame([("symbol:a#y", "symbol:b#z", "imports", ["ts-import"], None)], EDGE_SCHEMA)
    graph, made, bucketed = Graph(spark.createDataFrame(rows, "id string, kind string, file_path string"), edges), [], traverse.bucketed
    monkeypatch.setattr(traverse, "bucketed", lambda df, *by: made.append(bucketed(df, *by)) or made[-1])

    def reach(start, depth=None):
        return {(r.id, r.state) for r in traverse.reach(graph, spark.createDataFrame([(start,)], "id string"), depth).collect()}

    inside = {("file:a", 2), ("symbol:a#x", 2), ("symbol:a#y", 2), ("odd", 2)}
    assert reach("file:a") == inside | {("symbol:b#z", 2)}
    assert {r.to_id for r in made[0].rows.collect()} == {"symbol:a#y", "symbol:b#z", "odd"}
    assert [reach("file:a", 0), reach("file:a", 1), reach("symbol:a#x")] == [{("file:a", 2)}, inside, {("symbol:a#x", 2)}]


def test_a_round_shuffles_and_sorts_no_steps(spark):
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = traverse.bucketed(spark.range(9).selectExpr("id AS k", "id + 1 AS next").repartition(width, "k"), width, "k")
    level = traverse.bucketed(spark.range(3).repartition(width, "id"), width, "id")
    found = level.table.hint("shuffle_hash").join(steps.table, F.col("id") == F.col("k"), "left")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert steps.n == 9 and "Exchange" not in text and "Sort " not in text
    assert sorted(r.next for r in found.collect()) == [1, 2, 3]


def test_levels_that_are_joined_keep_the_highest_state(spark):
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = lambda *rows: traverse.bucketed(spark.createDataFrame(rows, "origin string, id string, state byte").repartition(width, "id"), width, "id")
    parts = [part(("", "a", 2), ("", "b", 1)), part(("", "c", 0)), part(("", "b", 2))]
    assert traverse.joined(parts, width, ("id",)) is parts
    first, rest = traverse.joined(parts, width, ("id",), most=2), traverse.joined([parts[1], parts[0], parts[2]], width, ("id",), most=2)
    assert [b.n for b in first] == [3] and [b.n for b in rest] == [3]
    assert {tuple(r) for r in first[0].table.collect()} == {("", "a", 2), ("", "b", 2), ("", "c", 0)}


def test_shared_reach_tells_what_each_origin_reaches(spark):
    rng = random.Random(5)
    files = [(f"file:{i}", "test" if i % 3 == 2 else "file", f"{i}") for i in range(24)]
    nodes = spark.createDataFrame([*files, *[(f"REQ-{i}", "req", "s") for i in range(20)]], "id string, kind string, file_path string")
    edges = set()
    for _ in range(26):
        i = rng.randrange(24)
        edges.add((f"file:{i}", f"REQ-{rng.randrange(20)}", "verifies" if i % 3 == 2 else "implements"))
        edges.add((f"file:{rng.randrange(24)}", f"file:{rng.randrange(12)}", "imports"))
        edges.add((f"REQ-{rng.randrange(20)}", f"file:{rng.randrange(24)}", "exercises"))
    graph = Graph(nodes, spark.createDataFrame([(*e, ["x"], None) for e in sorted(edges)], EDGE_SCHEMA))
    starts = spark.createDataFrame([(f"o{i}", f"file:{i}") for i in range(24)] + [("o1", "REQ-3"), ("gone", "file:99")], "origin string, id string")
    own, taken, held = traverse.shared_reach(graph, starts)
    got = {tuple(r) for r in own.union(taken.join(held, "hub").select("origin", "id")).collect()}
    assert got == {(r.origin, r.id) for r in traverse.reach_each(graph, starts).collect()}
    assert 1 < taken.count() < 25  # origins of both kinds
    deep = max(len({i for o, i in got if o == f"o{n}"}) for n in range(24))
    assert deep > 3


def test_plan_impact_has_no_depth():
    assert [name for name, sql in catalog.ORACLE.items() if "depth < 3" in sql and name in ("plan_impact", "plan_groups")] == []
