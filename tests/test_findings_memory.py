"""What the findings hold in a task."""

from weftgraph.graph import EDGE_SCHEMA, Graph
from weftgraph.operators import findings


def test_issues_list_no_sources_and_sort_no_nodes(spark):
    nodes = spark.createDataFrame([("REQ-1", "req", "s", "h"), ("REQ-2", "req", "s", "h"), ("file:a", "file", "a", "h")], "id string, kind string, file_path string, content_hash string")
    rows = [("file:a", "REQ-1", "implements"), ("file:a", "REQ-1", "verifies"), ("file:a", "REQ-9", "implements"), ("file:a", None, "verifies")]
    graph = Graph(nodes, spark.createDataFrame([(*r, ["code-tag"], None) for r in rows], EDGE_SCHEMA))
    lock = spark.createDataFrame([("REQ-2", "old"), ("REQ-1", "h")], "id string, content_hash string")
    results = spark.createDataFrame([("REQ-1", False)], "req_id string, passed boolean")
    found = findings.issues(graph, lock, results=results)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan
    assert "strategy=shuffle_hash" in plan
    assert {(r.category, r.id) for r in found.collect()} == {("drift", "REQ-2"), ("orphan", "file:a"), ("uncovered", "REQ-2"), ("testfail", "REQ-1")}
