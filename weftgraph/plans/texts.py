"""Queries over text made from the relational tables: specifications, code, reports, shards and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import mentions
from ..operators import extract, plan
from ..sources import results, shards
from . import projection as P
from .catalog import joined, query


def gathered(rows: DataFrame, key: str, head: str = "") -> DataFrame:
    """path and text from rows of key, k and line: at most a few dozen lines of a key, in order of k."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(F.col(key).alias("path")).agg(F.concat(F.lit(head), body).alias("text"))


def text(c: str):
    return F.col(c).cast("string")


def specs(spark, d) -> DataFrame:
    """20 customers a file, a list item each; every third has an annotation, with one id that is none."""
    k = F.col("c_custkey")
    note = F.when(k % 3 == 0, F.concat(F.lit(" (depends_on: REQ-"), (k + 1).cast("string"), F.lit(", no id)"))).otherwise("")
    line = F.concat(F.lit("- **REQ-"), text("c_custkey"), F.lit("**: "), "c_name", F.lit(" "), "c_mktsegment", note)
    path = F.concat(F.lit("specs/p"), F.floor(k / 20).cast("string"), F.lit(".md"))
    return gathered(P.table(spark, d, "customer").select(path.alias("key"), k.alias("k"), line.alias("line")), "key", "# Part\n\n```\n- REQ-1: code\n```\n")


SPEC = ", spec AS (SELECT c_custkey AS k, 'specs/p' || (c_custkey // 20) || '.md' AS file_path, '**REQ-' || c_custkey || '**: ' || c_name || ' ' || c_mktsegment AS item, 'REQ-' || c_custkey || ': ' || c_name || ' ' || c_mktsegment AS label, row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) + 5 AS line FROM customer)"


@query("SELECT 'REQ-' || k AS id, file_path, line, substr(sha256(label), 1, 16) AS content_hash FROM spec", SPEC)
def spec_requirements(spark, d):
    return extract.requirements(specs(spark, d)).select("id", "file_path", F.col("line").cast("long").alias("line"), "content_hash")


@query("SELECT 'REQ-' || k AS source, 'depends_on' AS kind, CASE WHEN good THEN 'REQ-' || (k + 1) ELSE 'no id' END AS target, file_path, CASE WHEN good THEN 'valid' ELSE 'invalid' END AS status FROM spec, (VALUES (true), (false)) v(good) WHERE k % 3 = 0", SPEC)
def spec_annotations(spark, d):
    return extract.annotations(specs(spark, d))


def code(spark, d) -> DataFrame:
    """A file an order: an import, a tag in the order's own comment, one in a string and one inside another comment, and a symbol."""
    o = P.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    k = text("o_orderkey")
    body = F.concat(
        F.lit("import { a } from './o"), (F.col("o_orderkey") + 1).cast("string"), F.lit("'\nconst s = \"// @impl REQ-1\" // see // @impl REQ-2\n// @impl REQ-"), text("o_custkey"),
        F.lit(", REQ-"), (F.col("o_custkey") + 1).cast("string"), F.lit("\nexport function f"), k, F.lit("() {}\nit('[auth/REQ-"), k, F.lit("] works') // req: \"REQ-7\"\n"),
    )
    return o.select(F.concat(F.lit("src/o"), k, F.lit(".ts")).alias("path"), body.alias("text"))


@query("SELECT 'src/o' || o_orderkey || '.ts' AS path, 3 AS line, 'REQ-' || (o_custkey + i) AS req_id FROM orders, (VALUES (0), (1)) v(i)")
def code_impl_tags(spark, d):
    return extract.implementation_tags(code(spark, d))


@query("SELECT 'src/o' || o_orderkey || '.ts' AS path, CASE WHEN i = 0 THEN 'auth/REQ-' || o_orderkey ELSE 'REQ-7' END AS req_id FROM orders, (VALUES (0), (1)) v(i)")
def code_test_tags(spark, d):
    return extract.test_tags(code(spark, d))


@query("SELECT 'symbol:src/o' || o_orderkey || '.ts#f' || o_orderkey AS id FROM orders")
def code_symbols(spark, d):
    return extract.exported_symbols(code(spark, d)).select("id")


@query("SELECT 'file:src/o' || a.o_orderkey || '.ts' AS source, 'file:src/o' || b.o_orderkey || '.ts' AS target FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def code_imports(spark, d):
    return extract.imports(code(spark, d))


def reports(spark, d) -> DataFrame:
    """JSON and JUnit reports of 100 events each; every second test is tagged in its suite only."""
    e = P.table(spark, d, "events").select("event_id", "user_id", "event_type")
    user, odd = text("user_id"), F.col("event_id") % 2 == 1
    title = F.when(odd, F.concat(F.lit("[REQ-"), user, F.lit("] "), "event_type")).otherwise(F.col("event_type"))
    suite = F.concat(F.lit("[auth/REQ-"), user, F.lit("]"))
    bad = F.col("event_type") == "error"
    test = F.struct(F.array(suite).alias("ancestorTitles"), title.alias("title"), F.when(bad, "failed").otherwise("passed").alias("status"))
    rows = e.select((F.floor(F.col("event_id") / 100)).alias("part"), test.alias("test"), F.concat(F.lit('<testsuite name="'), suite, F.lit('"><testcase time="1" name=\''), title, F.when(bad, "'><failure/></testcase></testsuite>").otherwise("'/></testsuite>")).alias("xml"))
    as_json = F.to_json(F.struct(F.array(F.struct(F.lit("a.test.ts").alias("name"), F.collect_list("test").alias("assertionResults"))).alias("testResults")))
    as_xml = F.concat(F.lit("\n<testsuites>"), F.array_join(F.collect_list("xml"), "\n"), F.lit("</testsuites>"))
    return rows.groupBy("part").agg(F.when(F.first("part") % 2 == 0, as_json).otherwise(as_xml).alias("text")).select("text")


@query("SELECT CASE WHEN event_id % 2 = 1 THEN 'REQ-' ELSE 'auth/REQ-' END || user_id AS req_id, CASE WHEN event_id % 2 = 1 THEN '[REQ-' || user_id || '] ' ELSE '' END || event_type AS test_name, event_type <> 'error' AS passed FROM events")
def test_results(spark, d):
    return results.read_results(reports(spark, d))


def shard_lines(spark, d) -> DataFrame:
    """A shard of 1000 events: a meta line, tests, some skipped and some broken lines; every seventh shard has another version."""
    e = P.table(spark, d, "events").select("event_id", "user_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).alias("k"))
    part, r = F.floor(F.col("event_id") / 1000), F.col("event_id") % 1000
    name = F.concat(F.lit("[REQ-"), text("user_id"), F.lit("] t"), (F.col("event_id") % 5).cast("string"))
    file = F.concat(F.lit("src/o"), "k", F.lit(".ts"))
    test = F.to_json(F.struct(F.lit("test").alias("kind"), name.alias("testName"), F.lit("a.test.ts").alias("testFile"), (F.col("event_type") != "error").alias("passed"), F.array(F.struct(file.alias("file"), F.lit("f").alias("fn"))).alias("hits"), F.create_map(file, F.concat(F.lit("h"), "k")).alias("hashes")))
    meta = F.concat(F.lit('{"kind":"meta","schemaVersion":'), F.when(part % 7 == 3, "2").otherwise("1"), F.lit("}"))
    skipped = F.to_json(F.struct(F.lit("skipped").alias("kind"), name.alias("testName"), F.lit("a.test.ts").alias("testFile"), F.lit("todo").alias("reason")))
    wrong = F.lit('{"kind":"test","testName":7,"testFile":"a","passed":true,"hits":[]}')
    line = F.when(r == 0, meta).when(r % 20 == 1, F.lit('{"kind":')).when(r % 20 == 2, skipped).when(r % 20 == 3, wrong).when(r % 20 == 4, F.lit("  ")).otherwise(test)
    return e.select(F.concat(F.lit("shard"), part.cast("string")).alias("shard"), line.alias("line"))


SHARDS = """, lines AS (SELECT event_id // 1000 AS part, event_id % 1000 AS r, '[REQ-' || user_id || '] t' || (event_id % 5) AS name, user_id, event_type <> 'error' AS passed, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events
), good AS (SELECT * FROM lines WHERE r <> 0 AND r % 20 NOT IN (1, 2, 3, 4) AND NOT EXISTS (SELECT 1 FROM lines m WHERE m.r = 0 AND m.part = lines.part AND m.part % 7 = 3))"""


@query("SELECT DISTINCT name AS test_name, passed, 'src/o' || k || '.ts' AS file FROM good", SHARDS)
def shard_tests(spark, d):
    tests, _, _ = shards.normalise(shards.parse(shard_lines(spark, d)))
    return tests.select("test_name", "passed", F.col("hits")[0]["file"].alias("file"))


@query("SELECT count(*) FILTER (r <> 0 AND r % 20 IN (1, 3)) AS corrupted, count(DISTINCT part) AS shards, count(DISTINCT part) FILTER (r = 0 AND part % 7 = 3) AS unknown_schema FROM lines", SHARDS)
def shard_diagnostics(spark, d):
    return shards.normalise(shards.parse(shard_lines(spark, d)))[2]


@query("SELECT DISTINCT 'REQ-' || user_id AS req_id, CASE WHEN s.sid IS NULL THEN 'file:src/o' || k || '.ts' ELSE s.sid END AS node_id FROM good JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 < 8) o ON o.o_orderkey = k LEFT JOIN (SELECT o_orderkey AS sk, 'symbol:src/o' || o_orderkey || '.ts#f' AS sid FROM orders WHERE o_orderkey % 2 = 0) s ON s.sk = k WHERE passed", SHARDS)
def shard_evidence(spark, d):
    tests, _, _ = shards.normalise(shards.parse(shard_lines(spark, d)))
    orders = P.table(spark, d, "orders").select("o_orderkey")
    path = P.path_of("o_orderkey", "src/o", ".ts")
    symbols = orders.filter("o_orderkey % 2 = 0").select(path.alias("path"), F.lit("f").alias("name"), F.concat(F.lit("symbol:"), path, F.lit("#f")).alias("id"))
    return shards.ingest(tests, symbols, orders.filter("o_orderkey % 10 < 8").select(path.alias("path")))["evidence"].select("req_id", "node_id")


def plans(spark, d) -> DataFrame:
    """A plan a supplier: a task with a file list, one inline list, a path past the scope's end, and a mention."""
    k = F.col("s_suppkey")
    n = lambda by: (k * 37 + by).cast("string")
    body = F.concat(
        F.lit("### T"), text("s_suppkey"), F.lit(": do\nFiles: ./src/o"), n(1), F.lit(".ts, src/x/../o"), n(2), F.lit(".ts (new).\n- src/o"), n(3), F.lit(".ts (changed)\n- src/o"), n(4),
        F.lit(".ts:l1\n- /etc/passwd\n\n\n- src/o"), n(5), F.lit(".ts\n- [ ] T9 next\nSee REQ-"), text("s_suppkey"), F.lit(".\n"),
    )
    return P.table(spark, d, "supplier").select(text("s_suppkey").alias("plan"), body.alias("text"))


PLANS = ", named AS (SELECT CAST(s_suppkey AS VARCHAR) AS plan, 'src/o' || (s_suppkey * 37 + i) || '.ts' AS path, CASE WHEN i = 4 THEN 'l1' END AS symbol, CASE WHEN i < 3 THEN 2 ELSE i END AS line FROM supplier, (VALUES (1), (2), (3), (4)) v(i))"


@query("SELECT plan, path, symbol, line FROM named", PLANS)
def plan_entries(spark, d):
    return plan.section_entries(plans(spark, d))[0]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS plan, CASE WHEN i = 0 THEN 'T' || s_suppkey ELSE 'T9' END AS task_id, i = 0 AS has_files FROM supplier, (VALUES (0), (1)) v(i)")
def plan_task_blocks(spark, d):
    return plan.task_blocks(plans(spark, d)).select("plan", "task_id", "has_files")


@query("SELECT plan, 'unresolvedFilePath' AS kind, path, CAST(NULL AS VARCHAR) AS symbol FROM named WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.file_path = named.path) UNION ALL SELECT plan, 'unresolvedSymbol', path, symbol FROM named WHERE symbol IS NOT NULL AND EXISTS (SELECT 1 FROM nodes n WHERE n.file_path = named.path) AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = 'symbol:' || path || '#' || symbol)", PLANS)
def plan_diagnostics(spark, d):
    g = P.graph(spark, d).stored()
    return plan.unresolved(plan.entries(plans(spark, d), g), g).select("plan", "kind", "path", "symbol")


@query("SELECT plan, req_id, req_id = 'REQ-' || plan AS mentioned, string_agg(path, ',' ORDER BY path) AS locations FROM (SELECT DISTINCT plan, path, e.target AS req_id FROM named JOIN edges e ON e.kind = 'implements' AND e.source = 'file:' || path JOIN nodes r ON r.id = e.target AND r.kind = 'req' WHERE symbol IS NULL) x GROUP BY plan, req_id", PLANS)
def plan_coverage(spark, d):
    return plan.plan_coverage(plans(spark, d), P.graph(spark, d).stored()).select("plan", "req_id", "mentioned", joined("locations"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS plan, s_suppkey < 0 AS inside, true AS whole FROM supplier")
def plan_mentions(spark, d):
    rows = plans(spark, d)
    return rows.select("plan", mentions(F.col("text"), F.concat(F.lit("REQ-"), "plan", F.lit("0"))).alias("inside"), mentions(F.col("text"), F.concat(F.lit("REQ-"), "plan")).alias("whole"))
