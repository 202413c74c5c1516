"""The driver's relational tables seen as an artifact graph, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, short_hash
from ..operators.canonical import dedup_edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(key: str, prefix: str, suffix: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(suffix))


def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier"))
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def shaped(df: DataFrame, node_id, kind, file_path, hashed) -> DataFrame:
        return df.select(node_id.alias("id"), kind.alias("kind"), file_path.alias("file_path"), F.lit(None).cast("string").alias("label"), short_hash(hashed).alias("content_hash"))

    docs = shaped(nation, path_of("n_nationkey", "doc:n", ""), F.lit("doc"), path_of("n_nationkey", "specs/n", ".md"), F.col("n_name"))
    alone = shaped(region, path_of("r_regionkey", "doc:r", ""), F.lit("doc"), path_of("r_regionkey", "specs/r", ".md"), F.col("r_name"))
    reqs = shaped(customer, path_of("c_custkey", "REQ-", ""), F.lit("req"), path_of("c_nationkey", "specs/n", ".md"), F.concat("c_name", F.lit("|"), "c_mktsegment"))
    tasks = shaped(supplier, path_of("s_suppkey", "T", ""), F.lit("task"), path_of("s_nationkey", "specs/n", ".md"), F.col("s_name"))
    kind = F.when(F.col("o_orderkey") % 10 >= 8, "test").otherwise("file")
    files = shaped(orders, path_of("o_orderkey", "file:src/o", ".ts"), kind, path_of("o_orderkey", "src/o", ".ts"), F.concat("o_orderstatus", F.lit("|"), "o_orderpriority"))
    code = orders.filter("o_orderkey % 10 < 8").select("o_orderkey")
    lines = lineitem.select("l_orderkey", "l_linenumber").distinct().join(code, F.col("l_orderkey") == F.col("o_orderkey"), "semi")
    symbol = F.concat(path_of("l_orderkey", "symbol:src/o", ".ts#l"), F.col("l_linenumber").cast("string"))
    symbols = shaped(lines, symbol, F.lit("symbol"), path_of("l_orderkey", "src/o", ".ts"), symbol)
    return docs.union(alone).union(reqs).union(tasks).union(files).union(symbols)


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges before canonicalisation, with repeats."""
    nation, customer, supplier = (table(spark, sf_dir, n) for n in ("nation", "customer", "supplier"))
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def edge(df: DataFrame, source, target, kind: str, provenance) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), F.array(provenance).alias("provenances"), F.lit(None).cast("string").alias("target_space"))

    file = path_of("o_orderkey", "file:src/o", ".ts")
    structural = F.lit("structural")
    parts = [
        edge(customer, path_of("c_nationkey", "doc:n", ""), path_of("c_custkey", "REQ-", ""), "contains", structural),
        edge(supplier, path_of("s_nationkey", "doc:n", ""), path_of("s_suppkey", "T", ""), "contains", structural),
        edge(orders.filter("o_orderkey % 10 < 8 and o_orderstatus = 'F' and o_orderkey % 97 <> 0"), file, path_of("o_custkey", "REQ-", ""), "implements", F.lit("code-tag")),
        edge(orders.filter("o_orderkey % 10 < 8 and o_orderkey % 97 = 0").withColumn("far", F.col("o_custkey") + 10_000_000), file, path_of("far", "REQ-", ""), "implements", F.lit("code-tag")),
        edge(orders.filter("o_orderkey % 10 >= 8"), file, path_of("o_custkey", "REQ-", ""), "verifies", F.lit("code-tag")),
        edge(supplier, path_of("s_suppkey", "T", ""), path_of("s_suppkey", "REQ-", ""), "verifies", F.lit("task-tag")),
        edge(lineitem.filter("l_linenumber = 1"), path_of("l_orderkey", "file:src/o", ".ts"), path_of("l_partkey", "file:src/o", ".ts"), "imports", F.lit("ts-import")),
        edge(lineitem.filter("l_linenumber = 2"), path_of("l_orderkey", "symbol:src/o", ".ts#l2"), path_of("l_partkey", "symbol:src/o", ".ts#l2"), "imports", F.lit("ts-import")),
    ]
    a, b = nation.alias("a"), nation.alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    ends = pairs.select(F.col("a.n_nationkey").alias("x"), F.col("b.n_nationkey").alias("y"))
    even = (F.col("x") + F.col("y")) % 2 == 0
    for provenance, rows in (("frontmatter", ends.filter(even)), ("inline-link", ends)):
        parts.append(edge(rows, path_of("x", "doc:n", ""), path_of("y", "doc:n", ""), "depends_on", F.lit(provenance)))
    found = evidence(spark, sf_dir)
    parts.append(edge(found, F.col("req_id"), F.col("node_id"), "exercises", F.lit("coverage")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions: every fourth user has files of its own, the others share a hundred."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    file = F.when(F.col("user_id") % 4 == 0, 100 + F.col("user_id") * 5 + k % 5).otherwise(k)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("REQ-"), F.col("user_id").cast("string")).alias("req_id"),
        F.concat(F.lit("file:src/o"), file.cast("string"), F.lit(".ts")).alias("node_id"),
        (F.col("event_type") != "error").alias("passed"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed executions."""
    return event_rows(spark, sf_dir).filter("passed").select("req_id", "node_id").distinct()


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).select("req_id", "passed")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(raw_nodes(spark, sf_dir), dedup_edges(raw_edges(spark, sf_dir)))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traced hashes: every third order's has changed since."""
    own = table(spark, sf_dir, "orders")
    now = F.concat("o_orderstatus", F.lit("|"), "o_orderpriority")
    return own.select(path_of("o_orderkey", "file:src/o", ".ts").alias("node_id"), short_hash(F.when(F.col("o_orderkey") % 3 == 0, F.concat(now, F.lit("|old"))).otherwise(now)).alias("hash"))


def lock(spark: SparkSession, sf_dir: str, altered: int = 11) -> DataFrame:
    """Requirement hashes, altered for every ``altered``-th; every 13th key is missing and every 50th has a stale twin."""
    customer = table(spark, sf_dir, "customer")
    now = F.concat("c_name", F.lit("|"), "c_mktsegment")
    text = F.when(F.col("c_custkey") % altered == 0, F.concat(now, F.lit("|old"))).otherwise(now)
    kept = customer.filter("c_custkey % 13 <> 0").select(path_of("c_custkey", "REQ-", "").alias("id"), short_hash(text).alias("content_hash"))
    gone = customer.filter("c_custkey % 50 = 0").select(path_of("c_custkey", "REQ-OLD-", "").alias("id"), short_hash(now).alias("content_hash"))
    return kept.union(gone)


def baseline(full: Graph) -> Graph:
    """An older graph: fewer claims, so other things are uncovered or orphaned, and every 22nd requirement had another text."""
    order = F.regexp_extract("source", r"o(\d+)\.ts", 1).cast("long")
    edges = full.edges.filter(~((F.col("kind") == "implements") & F.coalesce(order % 4 == 0, F.lit(False))))
    number = F.regexp_extract("id", r"^REQ-(\d+)$", 1).try_cast("long")
    changed = F.coalesce((F.col("kind") == "req") & (number % 22 == 0), F.lit(False))
    return Graph(full.nodes.withColumn("content_hash", F.when(changed, F.concat(F.lit("older"), "content_hash")).otherwise(F.col("content_hash"))), edges)


#: The same projection for DuckDB: each table and its text, which may read earlier ones.
TABLES = {
    "nodes": """
  SELECT 'doc:n' || n_nationkey AS id, 'doc' AS kind, 'specs/n' || n_nationkey || '.md' AS file_path, substr(sha256(n_name), 1, 16) AS content_hash FROM nation
  UNION ALL SELECT 'doc:r' || r_regionkey, 'doc', 'specs/r' || r_regionkey || '.md', substr(sha256(r_name), 1, 16) FROM region
  UNION ALL SELECT 'REQ-' || c_custkey, 'req', 'specs/n' || c_nationkey || '.md', substr(sha256(c_name || '|' || c_mktsegment), 1, 16) FROM customer
  UNION ALL SELECT 'T' || s_suppkey, 'task', 'specs/n' || s_nationkey || '.md', substr(sha256(s_name), 1, 16) FROM supplier
  UNION ALL SELECT 'file:src/o' || o_orderkey || '.ts', CASE WHEN o_orderkey % 10 >= 8 THEN 'test' ELSE 'file' END, 'src/o' || o_orderkey || '.ts', substr(sha256(o_orderstatus || '|' || o_orderpriority), 1, 16) FROM orders
  UNION ALL SELECT sid, 'symbol', path, substr(sha256(sid), 1, 16) FROM (
    SELECT DISTINCT 'symbol:src/o' || l_orderkey || '.ts#l' || l_linenumber AS sid, 'src/o' || l_orderkey || '.ts' AS path FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 < 8))
""",
    "ev": """
  SELECT 'REQ-' || user_id AS req_id, 'file:src/o' || CASE WHEN user_id % 4 = 0 THEN 100 + user_id * 5 + k % 5 ELSE k END || '.ts' AS node_id, event_type <> 'error' AS passed
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
""",
    "evidence": """
  SELECT DISTINCT req_id, node_id FROM ev WHERE passed
""",
    "raw": """
  SELECT 'doc:n' || c_nationkey AS source, 'REQ-' || c_custkey AS target, 'contains' AS kind, 'structural' AS p FROM customer
  UNION ALL SELECT 'doc:n' || s_nationkey, 'T' || s_suppkey, 'contains', 'structural' FROM supplier
  UNION ALL SELECT 'file:src/o' || o_orderkey || '.ts', 'REQ-' || o_custkey, 'implements', 'code-tag' FROM orders WHERE o_orderkey % 10 < 8 AND o_orderstatus = 'F' AND o_orderkey % 97 <> 0
  UNION ALL SELECT 'file:src/o' || o_orderkey || '.ts', 'REQ-' || (o_custkey + 10000000), 'implements', 'code-tag' FROM orders WHERE o_orderkey % 10 < 8 AND o_orderkey % 97 = 0
  UNION ALL SELECT 'file:src/o' || o_orderkey || '.ts', 'REQ-' || o_custkey, 'verifies', 'code-tag' FROM orders WHERE o_orderkey % 10 >= 8
  UNION ALL SELECT 'T' || s_suppkey, 'REQ-' || s_suppkey, 'verifies', 'task-tag' FROM supplier
  UNION ALL SELECT 'file:src/o' || l_orderkey || '.ts', 'file:src/o' || l_partkey || '.ts', 'imports', 'ts-import' FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT 'symbol:src/o' || l_orderkey || '.ts#l2', 'symbol:src/o' || l_partkey || '.ts#l2', 'imports', 'ts-import' FROM lineitem WHERE l_linenumber = 2
  UNION ALL SELECT 'doc:n' || a.n_nationkey, 'doc:n' || b.n_nationkey, 'depends_on', p FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey,
    (VALUES ('frontmatter'), ('inline-link')) v(p) WHERE p = 'inline-link' OR (a.n_nationkey + b.n_nationkey) % 2 = 0
  UNION ALL SELECT req_id, node_id, 'exercises', 'coverage' FROM evidence
""",
    "edges": """
  SELECT source, target, kind, string_agg(DISTINCT p, ',' ORDER BY p) AS provenances FROM raw GROUP BY source, target, kind
""",
    "claims": """
  SELECT e.* FROM edges e LEFT JOIN nodes n ON n.id = e.source WHERE n.kind IS DISTINCT FROM 'task'
""",
    "hashes": """
  SELECT 'file:src/o' || o_orderkey || '.ts' AS node_id, substr(sha256(o_orderstatus || '|' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '|old' ELSE '' END), 1, 16) AS hash FROM orders
""",
    "lock": """
  SELECT 'REQ-' || c_custkey AS id, substr(sha256(c_name || '|' || c_mktsegment || CASE WHEN c_custkey % 11 = 0 THEN '|old' ELSE '' END), 1, 16) AS content_hash FROM customer WHERE c_custkey % 13 <> 0
  UNION ALL SELECT 'REQ-OLD-' || c_custkey, substr(sha256(c_name || '|' || c_mktsegment), 1, 16) FROM customer WHERE c_custkey % 50 = 0
""",
    "excl": """
  SELECT node_id, min(req_id) AS req_id FROM evidence GROUP BY node_id HAVING count(DISTINCT req_id) = 1
""",
    "cov": """
  SELECT r.id AS req_id, i.f AS impl_files, t.f AS test_files, res.ok AS ok, x.req_id IS NOT NULL AS alone FROM nodes r
  LEFT JOIN (SELECT target, string_agg(DISTINCT source, ',' ORDER BY source) AS f FROM claims WHERE kind = 'implements' GROUP BY target) i ON i.target = r.id
  LEFT JOIN (SELECT target, string_agg(DISTINCT source, ',' ORDER BY source) AS f FROM claims WHERE kind = 'verifies' GROUP BY target) t ON t.target = r.id
  LEFT JOIN (SELECT req_id, bool_and(passed) AS ok FROM ev GROUP BY req_id) res ON res.req_id = r.id
  LEFT JOIN (SELECT DISTINCT req_id FROM excl) x ON x.req_id = r.id WHERE r.kind = 'req'
""",
}


def with_tables(extra: str, sql: str, loops: bool = False) -> str:
    """``sql`` behind the tables that it and ``extra``, its own common tables, read; ``loops`` if one of those reads itself."""
    text, needed = extra + " " + sql, []
    for name, body in reversed(TABLES.items()):
        if re.search(rf"\b{name}\b", text):
            needed.append(f"{name} AS MATERIALIZED ({body})")
            text += body
    own = [", ".join(reversed(needed))] if needed else []
    own += [extra.strip().removeprefix(",").strip()] if extra.strip() else []
    return f"WITH {'RECURSIVE ' if loops else ''}{', '.join(own)} {sql}" if own else sql
