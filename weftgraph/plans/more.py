"""Queries over the graph build, lock files, plan impact, viewer rows and the rest of the operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, shared_folder, stored
from ..operators import build, canonical, evidence, findings, plan, rewrite, snapshot, traverse
from ..sources import lock as locks
from ..sources import shards
from . import projection as P
from .catalog import ISSUES, LOCKED, REACH, covered, joined, lock_rows, query, starts
from .texts import PLANS, SHARDS, SPEC, code, plans, shard_lines, specs

num = lambda c: F.col(c).cast("string")


# The build, from text to graph.
BUILT = SPEC + """, known AS (SELECT 'REQ-' || c_custkey AS id FROM customer)"""


def built(spark, d):
    return build.build(specs(spark, d).unionByName(code(spark, d)))


@query(
    "SELECT 'doc:p' || (k // 20) || '.md' AS source, 'REQ-' || k AS target, 'contains' AS kind, 'structural' AS provenances FROM spec "
    "UNION ALL SELECT 'REQ-' || k, 'REQ-' || (k + 1), 'depends_on', 'annotation' FROM spec WHERE k % 3 = 0 "
    "UNION SELECT 'symbol:src/o' || o_orderkey || '.ts#f' || o_orderkey, 'REQ-' || (o_custkey + i), 'implements', 'code-tag' FROM orders, (VALUES (0), (1)) v(i) "
    "UNION SELECT 'file:src/o' || a.o_orderkey || '.ts', 'file:src/o' || b.o_orderkey || '.ts', 'imports', 'ts-import' FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1",
    BUILT,
)
def built_edges(spark, d):
    return built(spark, d)[0].edges.select("source", "target", "kind", joined("provenances"))


@query(
    "SELECT 'REQ-' || k AS id, 'req' AS kind, file_path, substr(sha256(label), 1, 16) AS content_hash FROM spec "
    "UNION ALL SELECT 'file:src/o' || o_orderkey || '.ts', 'file', 'src/o' || o_orderkey || '.ts', NULL FROM orders "
    "UNION ALL SELECT 'symbol:src/o' || o_orderkey || '.ts#f' || o_orderkey, 'symbol', 'src/o' || o_orderkey || '.ts', NULL FROM orders "
    "UNION ALL SELECT DISTINCT 'doc:p' || (k // 20) || '.md', 'doc', file_path, NULL FROM spec",
    BUILT,
)
def built_nodes(spark, d):
    nodes = built(spark, d)[0].nodes
    return nodes.select("id", "kind", "file_path", F.when(F.col("kind") == "req", F.col("content_hash")).alias("content_hash"))


@query(
    "SELECT 'invalid-annotation-id' AS type, 'no id' AS id, file_path AS file FROM spec WHERE k % 3 = 0 "
    "UNION SELECT 'orphan-edge', 'REQ-' || (k + 1), file_path FROM spec WHERE k % 3 = 0 AND NOT EXISTS (SELECT 1 FROM known WHERE known.id = 'REQ-' || (k + 1)) "
    "UNION SELECT 'phantom-import-repaired', 'symbol:src/o' || b.o_orderkey || '.ts#a', 'src/o' || a.o_orderkey || '.ts' FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 "
    "UNION SELECT 'unresolved-import', './o' || (a.o_orderkey + 1), 'src/o' || a.o_orderkey || '.ts' FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey + 1)",
    BUILT,
)
def built_warnings(spark, d):
    return built(spark, d)[1]


@query(
    "SELECT path, string_agg(CASE WHEN k = 10 THEN replace(line, 'REQ-10**', 'REQ-TEN**') WHEN k = 9 THEN replace(line, 'REQ-10,', 'REQ-TEN,') ELSE line END, chr(10) ORDER BY k) AS body, count(*) FILTER (k IN (9, 10)) AS n_changes FROM ("
    "SELECT file_path AS path, k, '- ' || item || CASE WHEN k % 3 = 0 THEN ' (depends_on: REQ-' || (k + 1) || ', no id)' ELSE '' END AS line FROM spec) x GROUP BY path",
    SPEC,
)
def renamed_specs(spark, d):
    head = "# Part\n\n```\n- REQ-1: code\n```\n"
    out = rewrite.rename_in_text(specs(spark, d), "REQ-10", "REQ-TEN")
    return out.select("path", F.substring("text", len(head) + 1, 10_000_000).alias("body"), "n_changes")


# Lock files and changes of keys.
def new_lock(spark, d):
    return snapshot.build_lock(P.graph(spark, d).stored(), "now")


@query("SELECT * FROM newlock", LOCKED)
def lock_roundtrip(spark, d):
    folder = f"{shared_folder(spark)}/lock-{uuid.uuid4().hex}"
    locks.write_lock(new_lock(spark, d).filter("id <> 'REQ-1'"), folder)
    locks.write_lock(new_lock(spark, d), folder)
    return lock_rows(locks.read_lock(spark, folder))


@query(
    "SELECT * FROM newlock WHERE id NOT IN ('REQ-9', 'REQ-10') UNION ALL SELECT 'REQ-M', (SELECT spec_file FROM newlock WHERE id = 'REQ-9'), (SELECT content_hash FROM newlock WHERE id = 'REQ-9'), "
    "(SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM claims WHERE kind = 'implements' AND target IN ('REQ-9', 'REQ-10')), "
    "(SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM claims WHERE kind = 'verifies' AND target IN ('REQ-9', 'REQ-10')), "
    "(SELECT string_agg(DISTINCT target, ',' ORDER BY target) FROM edges WHERE kind = 'exercises' AND source IN ('REQ-9', 'REQ-10')), NULL",
    LOCKED,
)
def merged_lock(spark, d):
    return lock_rows(snapshot.merge_keys(new_lock(spark, d), ["REQ-9", "REQ-10"], "REQ-M"))


def older_lock(spark, d):
    older = F.coalesce(F.regexp_extract("id", r"^REQ-(\d+)$", 1).try_cast("long") % 11 == 0, F.lit(False))
    return stored(snapshot.build_lock(P.graph(spark, d).stored(), "then").withColumn("content_hash", F.when(older, "old").otherwise(F.col("content_hash"))))


AGED = "coalesce(TRY_CAST(regexp_extract(id, '^REQ-([0-9]+)$', 1) AS BIGINT) % 11 = 0, false)"


@query(f"SELECT id, CASE WHEN {AGED} THEN 'now' ELSE 'then' END AS last_reconciled FROM newlock", LOCKED)
def kept_times(spark, d):
    return snapshot.build_lock(P.graph(spark, d).stored(), "now", older_lock(spark, d)).select("id", "last_reconciled")


@query(f"SELECT id FROM newlock WHERE NOT {AGED}", LOCKED)
def equal_entries(spark, d):
    return snapshot.entries_equal(new_lock(spark, d), older_lock(spark, d))


# Findings with a scope, renames, flags and ignored ids.
SCOPE = ", scope AS (SELECT id FROM nodes WHERE kind = 'req' AND length(id) % 2 = 0 UNION ALL SELECT id FROM nodes WHERE kind = 'file' AND file_path LIKE '%7.ts')"


def scope(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'req' and length(id) % 2 = 0 or kind = 'file' and file_path like '%7.ts'").select("id")


@query("SELECT category, id, key FROM cur WHERE EXISTS (SELECT 1 FROM scope WHERE scope.id = cur.id)", ISSUES + SCOPE)
def scoped_issues(spark, d):
    g = P.graph(spark, d).stored()
    return findings.issues(g, P.lock(spark, d), scope(g), P.results(spark, d))


@query("SELECT category, id, key, is_new AND NOT (category = 'uncovered' AND id LIKE '%5') AS is_new FROM checked", ISSUES)
def check_ignored(spark, d):
    g, lock = P.graph(spark, d).stored(), P.lock(spark, d)
    checked = findings.check(findings.issues(g, lock, results=P.results(spark, d)), findings.issues(P.baseline(g), lock))
    return findings.without_ignored(checked, g.kinds("req").filter("id like '%5'").select("id"))


@query("SELECT replace(source, 'src/', 'lib/') AS source, target, kind, replace(source, 'src/', 'lib/') || ' -> ' || target || ' (' || kind || ')' AS text FROM claims WHERE kind IN ('implements', 'verifies') AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = claims.target)")
def renamed_orphans(spark, d):
    g = P.graph(spark, d).stored()
    renames = g.kinds("file").select(F.col("file_path").alias("old_path"), F.replace("file_path", F.lit("src/"), F.lit("lib/")).alias("new_path"))
    return findings.renamed_sources(findings.orphans(g), renames)


@query("SELECT source, target, kind FROM edges WHERE kind IN ('implements', 'verifies') AND contains(provenances, 'code-tag') AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = edges.target)")
def dangling_tags(spark, d):
    return findings.dangling_code_tags(P.graph(spark, d))


@query("SELECT req_id FROM cov WHERE impl_files IS NULL AND alone")
def exercisable(spark, d):
    return findings.would_be_exercised(P.graph(spark, d).stored(), None, P.evidence(spark, d))


# Reach with a depth and with stale evidence.
DEEP = ", deep AS (SELECT id, 2 AS state, 0 AS depth FROM starts UNION SELECT steps.b, steps.t, depth + 1 FROM deep JOIN steps ON steps.a = deep.id AND steps.s = deep.state AND deep.state > 0 WHERE depth < 3)"


@query("SELECT id, max(state) AS state FROM deep GROUP BY id", REACH + DEEP)
def impact_depth(spark, d):
    return traverse.reach(P.graph(spark, d).stored(), starts(spark), max_depth=3)


@query("SELECT id, state FROM visited", REACH.replace("FROM edges e LEFT JOIN nodes n ON n.id = e.source, anyx", "FROM edges e LEFT JOIN nodes n ON n.id = e.source, anyx WHERE NOT (e.kind = 'exercises' AND e.target LIKE '%3.ts')"))
def impact_without_stale(spark, d):
    g = P.graph(spark, d).stored()
    return traverse.reach(g, starts(spark), stale=g.nodes.filter("id like '%3.ts'").select("id"))


# Plan impact over the whole graph, three steps deep.
PLAN_REACH = PLANS + """, origins AS MATERIALIZED (SELECT DISTINCT path || coalesce(':' || symbol, '') AS origin, path, symbol FROM named
), pstarts AS MATERIALIZED (
  SELECT origin, n.id AS id FROM origins JOIN nodes n ON n.id = 'symbol:' || path || '#' || symbol
  UNION SELECT origin, f.id FROM origins JOIN nodes f ON f.id = 'file:' || path WHERE symbol IS NULL
  UNION SELECT origin, s.id FROM origins JOIN nodes f ON f.id = 'file:' || path JOIN nodes s ON s.file_path = path AND s.kind = 'symbol' WHERE symbol IS NULL
), impl AS MATERIALIZED (SELECT DISTINCT target AS id FROM edges JOIN nodes n ON n.id = target WHERE edges.kind = 'implements' AND n.kind = 'req'
), hit AS MATERIALIZED (SELECT DISTINCT origin, e.source AS req FROM pstarts JOIN edges e ON e.kind = 'exercises' AND e.target = pstarts.id
), fe AS MATERIALIZED (SELECT e.*, coalesce(n.kind = 'test', false) AS from_test, ti.id IS NOT NULL AS ti, si.id IS NOT NULL AS si FROM edges e LEFT JOIN nodes n ON n.id = e.source LEFT JOIN impl ti ON ti.id = e.target LEFT JOIN impl si ON si.id = e.source
), steps AS MATERIALIZED (
  SELECT source AS a, 2 AS s, target AS b, CASE WHEN kind = 'exercises' OR kind = 'depends_on' AND provenances = 'inline-link' THEN 0 ELSE 2 END AS t, false AS nh FROM fe
  UNION ALL SELECT source, 1, target, CASE WHEN kind IN ('exercises', 'verifies') OR kind = 'depends_on' AND provenances = 'inline-link' THEN 0 ELSE 2 END, kind = 'verifies' FROM fe WHERE kind <> 'imports' AND (kind <> 'verifies' OR NOT ti)
  UNION ALL SELECT target, s, source, CASE WHEN kind = 'exercises' OR kind = 'depends_on' AND provenances = 'inline-link' THEN 0 WHEN kind IN ('verifies', 'imports') AND from_test THEN 1 ELSE 2 END, false FROM fe, (VALUES (1), (2)) v(s) WHERE kind <> 'contains' AND (kind <> 'exercises' OR NOT si)
  UNION ALL SELECT f.id, s, x.id, 2, false FROM nodes f JOIN nodes x USING (file_path), (VALUES (1), (2)) v(s) WHERE f.kind = 'file' AND x.kind = 'symbol'
), pwalk AS (
  SELECT origin, id, 2 AS state, 0 AS depth FROM pstarts UNION SELECT w.origin, st.b, st.t, depth + 1 FROM pwalk w JOIN steps st ON st.a = w.id AND st.s = w.state AND w.state > 0 LEFT JOIN hit h ON h.origin = w.origin AND h.req = st.b WHERE depth < 3 AND (NOT st.nh OR h.req IS NOT NULL)
), pimpact AS MATERIALIZED (SELECT DISTINCT origin, w.id AS req FROM pwalk w JOIN nodes n ON n.id = w.id AND n.kind = 'req'
), closed AS (
  SELECT origin, id FROM pstarts UNION SELECT c.origin, e.target FROM closed c JOIN edges e ON e.source = c.id AND e.kind = 'imports' AND e.target LIKE 'symbol:%'
), pown AS MATERIALIZED (SELECT DISTINCT origin, e.target AS req FROM closed JOIN edges e ON e.kind = 'implements' AND e.source = closed.id JOIN nodes n ON n.id = e.target AND n.kind = 'req'
), entry AS MATERIALIZED (SELECT DISTINCT plan, path, symbol, path || coalesce(':' || symbol, '') AS origin FROM named WHERE path || coalesce(':' || symbol, '') IN (SELECT origin FROM pstarts)
), seen AS MATERIALIZED (SELECT plan, path, symbol, origin, req FROM entry JOIN pimpact USING (origin) WHERE req <> 'REQ-' || plan AND req NOT LIKE '%4')"""


# The same over any number of steps.
WHOLE_REACH = PLAN_REACH.replace("2 AS state, 0 AS depth FROM pstarts", "2 AS state FROM pstarts").replace("st.t, depth + 1 FROM pwalk", "st.t FROM pwalk").replace("WHERE depth < 3 AND (NOT st.nh", "WHERE (NOT st.nh")


def planned(spark, d, max_depth: int | None = 3):
    g = P.graph(spark, d).stored()
    texts = plans(spark, d)
    found = stored(plan.entries(texts, g))
    impacts = plan.entry_impact(found, g, max_depth)
    return g, texts, found, stored(impacts) if max_depth is not None else impacts


@query(
    "SELECT plan, path, symbol, coalesce((SELECT string_agg(req, ',' ORDER BY req) FROM pimpact i WHERE i.origin = entry.origin), '') AS impact, coalesce((SELECT string_agg(req, ',' ORDER BY req) FROM pown o WHERE o.origin = entry.origin), '') AS origin FROM entry", WHOLE_REACH
)
def plan_impact(spark, d):
    return planned(spark, d, None)[3].select("plan", "path", "symbol", joined("impact"), joined("origin"))


def implicit(spark, d):
    g, texts, _, impacts = planned(spark, d)
    return plan.implicit_impacts(texts, impacts, g.kinds("req").filter("id like '%4'").select(F.col("id").alias("req_id")))


@query(
    "SELECT plan, path, symbol, string_agg(req, ',' ORDER BY req) AS impact, coalesce((SELECT string_agg(req, ',' ORDER BY req) FROM pown o WHERE o.origin = seen.origin AND req NOT LIKE '%4'), '') AS origin, "
    "coalesce(string_agg(req, ',' ORDER BY req) FILTER (NOT EXISTS (SELECT 1 FROM pown o WHERE o.origin = seen.origin AND o.req = seen.req)), '') AS drift FROM seen GROUP BY plan, path, symbol, origin", WHOLE_REACH
)
def plan_groups(spark, d):
    g, texts, _, impacts = planned(spark, d, None)
    reqs = g.kinds("req").select("id")
    return plan.implicit_groups(texts, impacts, reqs, reqs.filter("id like '%4'").select(F.col("id").alias("req_id"))).select("plan", "path", "symbol", joined("impact"), joined("origin"), joined("drift"))


@query("SELECT plan, req AS req_id, string_agg(DISTINCT origin, ',' ORDER BY origin) AS locations FROM seen GROUP BY plan, req", PLAN_REACH)
def plan_by_requirement(spark, d):
    return implicit(spark, d)[1].select("plan", "req_id", joined("locations"))


@query("SELECT plan, count(*) AS total, count(*) FILTER (m) AS mentioned, count(*) FILTER (NOT m AND NOT i) AS implicit, count(*) FILTER (i AND NOT m) AS ignored FROM (SELECT DISTINCT plan, req, req = 'REQ-' || plan AS m, req LIKE '%4' AS i FROM entry JOIN pimpact USING (origin)) x GROUP BY plan", PLAN_REACH)
def plan_counts(spark, d):
    return implicit(spark, d)[2]


@query(
    "SELECT CAST(s_suppkey AS VARCHAR) AS plan, 'missingFilesSection' AS kind, 'T9' AS detail FROM supplier UNION ALL SELECT plan, 'unresolvedFilePath', path || coalesce(':' || symbol, '') FROM named WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.file_path = named.path) AND symbol IS NULL "
    "UNION ALL SELECT plan, 'unresolvedFilePath', path FROM named WHERE symbol IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.file_path = named.path) "
    "UNION ALL SELECT plan, 'unresolvedSymbol', path || ':' || symbol FROM named WHERE symbol IS NOT NULL AND EXISTS (SELECT 1 FROM nodes n WHERE n.file_path = named.path) AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = 'symbol:' || path || '#' || symbol) "
    "UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'emptyExtraction', NULL FROM supplier WHERE CAST(s_suppkey AS VARCHAR) NOT IN (SELECT plan FROM entry)", PLAN_REACH
)
def plan_findings(spark, d):
    g, texts, found, impacts = planned(spark, d)
    return plan.diagnostics(texts, found, impacts, g).select("plan", "kind", "detail")


# Structure: viewer rows, enclosing symbols, conventions, last writers.
STATES = """, drifted AS (SELECT DISTINCT l.id AS id FROM lock l JOIN nodes n USING (id) WHERE l.content_hash <> n.content_hash
), lost AS (SELECT DISTINCT source AS id FROM claims WHERE kind IN ('implements', 'verifies') AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = claims.target)
), bare AS (SELECT req_id AS id FROM cov WHERE impl_files IS NULL
), shown AS MATERIALIZED (SELECT n.id AS id, CASE WHEN n.kind IN ('req') THEN n.id WHEN n.kind = 'symbol' THEN split_part(n.id, '#', 2) ELSE regexp_extract(file_path, '([^/]*)$', 1) END AS label,
  CASE WHEN n.kind IN ('file', 'symbol') THEN 'code' ELSE n.kind END AS layer, n.kind AS kind, CASE WHEN d.id IS NOT NULL THEN 'drift' WHEN o.id IS NOT NULL THEN 'orphan' WHEN u.id IS NOT NULL THEN 'uncovered' ELSE 'ok' END AS state, file_path
  FROM nodes n LEFT JOIN drifted d ON d.id = n.id LEFT JOIN lost o ON o.id = n.id LEFT JOIN bare u ON u.id = n.id WHERE n.kind <> 'task'
), linked AS MATERIALIZED (SELECT e.source AS source, e.target AS target, e.kind AS kind, e.provenances AS provenances FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE s.kind <> 'task' AND t.kind <> 'task')"""


def viewed(spark, d):
    g = P.graph(spark, d).stored()
    drifted = findings.drift(g, P.lock(spark, d)).select(F.col("node_id").alias("id"))
    bare = findings.coverage(g).filter("status = 'untagged'").select(F.col("req_id").alias("id"))
    return canonical.viewer_rows(g, drifted, findings.orphans(g).select(F.col("source").alias("id")), bare)


@query("SELECT * FROM shown", STATES)
def viewer_nodes(spark, d):
    return viewed(spark, d)[0]


@query("SELECT * FROM linked", STATES)
def viewer_edges(spark, d):
    return viewed(spark, d)[1].select("source", "target", "kind", joined("provenances"))


@query("SELECT count(*) AS nodes, count(*) FILTER (state = 'drift') AS drift, count(*) FILTER (state = 'orphan') AS orphan, count(*) FILTER (state = 'uncovered') AS uncovered, (SELECT count(*) FROM linked) AS edges FROM shown", STATES)
def viewer_totals(spark, d):
    return canonical.viewer_counts(*viewed(spark, d))


@query("SELECT 'src/o' || o_orderkey || '.ts' AS path, line, CASE WHEN line = 40 THEN NULL WHEN line = 7 THEN 'B' || o_orderkey ELSE 'A' || o_orderkey END AS symbol_id FROM orders, (VALUES (3), (7), (40)) v(line)")
def tag_symbols(spark, d):
    o = P.table(spark, d, "orders").select("o_orderkey", P.path_of("o_orderkey", "src/o", ".ts").alias("path"))
    tags = o.select("path", F.explode(F.array(F.lit(3), F.lit(7), F.lit(40))).alias("line"))
    ranges = F.array(*[F.struct(F.concat(F.lit(n), num("o_orderkey")).alias("id"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(a).alias("seq")) for n, a, b in (("A", 1, 20), ("B", 5, 10))])
    return canonical.enclosing_symbols(tags, o.select("path", F.inline(ranges)))


@query("SELECT 'd' || s_suppkey || a AS source, 'd' || s_suppkey || b AS target, 'derives_from' AS kind FROM supplier, (VALUES ('design', 'requirements'), ('tasks', 'design'), ('tasks', 'plan')) v(a, b) WHERE b <> 'plan' OR s_suppkey % 2 = 0")
def doc_conventions(spark, d):
    s = P.table(spark, d, "supplier").select("s_suppkey")
    stems = F.explode(F.array(*map(F.lit, ("requirements", "design", "Tasks", "notes", "plan")))).alias("stem")
    docs = s.select("s_suppkey", stems).filter("stem <> 'plan' or s_suppkey % 2 = 0")
    path = F.concat(F.lit("specs/f"), num("s_suppkey"), F.lit("/"), "stem", F.lit(".md"))
    nodes = docs.select(F.concat(F.lit("d"), num("s_suppkey"), F.lower("stem")).alias("id"), F.lit("doc").alias("kind"), path.alias("file_path"))
    return canonical.convention_edges(nodes).select("source", "target", "kind")


def written(spark, d):
    o = P.table(spark, d, "orders")
    nodes = o.select(F.concat(F.lit("N"), num("o_custkey")).alias("id"), F.lit("req").alias("kind"), F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")).alias("file_path"), F.col("o_orderkey").alias("seq"))
    return canonical.last_nodes(nodes)


@query("SELECT 'N' || o_custkey AS id, 'f' || (max(o_orderkey) % 3) AS file_path FROM orders GROUP BY o_custkey")
def last_written(spark, d):
    return written(spark, d)[0].select("id", "file_path")


@query("SELECT 'duplicate-id' AS type, 'N' || o_custkey AS id, string_agg(DISTINCT 'f' || (o_orderkey % 3), ',' ORDER BY 'f' || (o_orderkey % 3)) AS files FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 3) > 1")
def duplicate_ids(spark, d):
    return written(spark, d)[1].select("type", "id", joined("files"))


# Evidence: status, and classes through members of classes.
@query(
    "SELECT CAST(3 AS INTEGER) AS n_shards, (SELECT count(*) FROM (SELECT DISTINCT name, passed, k FROM good)) AS n_tests, (SELECT count(*) FROM (SELECT DISTINCT name, passed, k FROM good)) AS n_tagged, "
    "(SELECT count(DISTINCT name) FROM lines l WHERE r % 20 = 2 AND NOT EXISTS (SELECT 1 FROM lines m WHERE m.r = 0 AND m.part = l.part AND m.part % 7 = 3)) AS n_skipped, (SELECT count(*) FROM stale) / (SELECT count(*) FROM hashes) AS stale_rate",
    ", stale AS MATERIALIZED (SELECT DISTINCT h.node_id AS id FROM hashes h LEFT JOIN nodes n ON n.id = h.node_id WHERE n.content_hash IS DISTINCT FROM h.hash)" + SHARDS,
)
def trace_status(spark, d):
    tests, skipped, _ = shards.normalise(shards.parse(shard_lines(spark, d)))
    tagged = tests.withColumn("req_ids", shards.inherited_tags(F.col("test_name"), F.col("suite_path")))
    h = P.hashes(spark, d)
    return evidence.status(tagged, skipped, h, evidence.stale_nodes(P.graph(spark, d), h), 3)


@query(
    "SELECT CASE WHEN p_partkey % 4 = 3 THEN 'unexercised' ELSE 'corroborated' END AS class, 'REQ-' || p_partkey AS req_id, 'symbol:src/p' || p_partkey || '.ts#C' || CASE WHEN p_partkey % 4 = 2 THEN '.constructor' ELSE '' END AS node_id FROM part "
    "UNION ALL SELECT 'suggested', 'FREE-' || p_partkey, 'symbol:src/p' || p_partkey || '.ts#C.n' FROM part"
)
def member_classes(spark, d):
    """A class a part: its claim is proven by itself, by a member two steps below, by its constructor's class, or not at all."""
    k = P.table(spark, d, "part").select("p_partkey")
    s = lambda tail: F.concat(F.lit("symbol:src/p"), num("p_partkey"), F.lit(".ts#" + tail))
    kind = F.col("p_partkey") % 4
    node = lambda tail: F.struct(s(tail).alias("id"), F.lit("symbol").alias("kind"))
    nodes = k.select(F.inline(F.array(node("C"), node("C.m"), node("C.m.x"), node("C.n"), node("C.constructor"), F.struct(F.concat(F.lit("REQ-"), num("p_partkey")).alias("id"), F.lit("req").alias("kind")))))
    edge = lambda a, b, what: F.struct(a.alias("source"), b.alias("target"), F.lit(what).alias("kind"))
    req = F.concat(F.lit("REQ-"), num("p_partkey"))
    claimed = F.when(kind == 2, s("C.constructor")).otherwise(s("C"))
    edges = k.select(F.inline(F.array(edge(s("C"), s("C.m"), "contains"), edge(s("C.m"), s("C.m.x"), "contains"), edge(s("C"), s("C.n"), "contains"), edge(s("C"), s("C.constructor"), "contains"), edge(claimed, req, "implements"))))
    hit = F.when(kind == 1, s("C.m.x")).when(kind.isin(0, 2), s("C"))
    pair = lambda r, n: F.struct(r.alias("req_id"), n.alias("node_id"))
    pairs = k.select(F.inline(F.array(pair(req, hit), pair(F.concat(F.lit("FREE-"), num("p_partkey")), s("C.n"))))).filter("node_id is not null")
    return evidence.classify(Graph(nodes, edges), pairs).select("class", "req_id", "node_id")


# Small changes of ids.
@query("SELECT DISTINCT replace(name, '[REQ-7]', '[REQ-SEVEN]') AS test_name, passed, 'src/o' || k || '.ts' AS file FROM good", SHARDS)
def renamed_titles(spark, d):
    tests, _, _ = shards.normalise(shards.parse(shard_lines(spark, d)))
    return rewrite.rename_in_titles(tests, "REQ-7", "REQ-SEVEN").select("test_name", "passed", F.col("hits")[0]["file"].alias("file"))


@query("SELECT 'Requirement-7' AS target, string_agg('T' || s_suppkey, ',' ORDER BY 'T' || s_suppkey) AS tasks FROM supplier WHERE s_suppkey % 10 = 7 AND s_suppkey % 3 <> 0")
def refused_renames(spark, d):
    s = P.table(spark, d, "supplier")
    edges = s.select(F.concat(F.lit("T"), num("s_suppkey")).alias("source"), F.concat(F.lit("Requirement-"), (F.col("s_suppkey") % 10).cast("string")).alias("target"), F.when(F.col("s_suppkey") % 3 != 0, "requirement").alias("target_space"))
    return rewrite.refused_references(edges, "Requirement-7").select("target", joined("tasks"))


@query("SELECT 'late' AS type, 'C' || c_custkey AS id FROM customer WHERE c_custkey % 3 = 0")
def added_warnings(spark, d):
    rows = P.table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, "late").otherwise("early").alias("type"), F.concat(F.lit("C"), num("c_custkey")).alias("id"))
    return rewrite.new_warnings(rows, rows.filter("type = 'early'"))


@query(f"SELECT req_id, status, impl_files, test_files FROM (SELECT req_id, CASE WHEN impl_files IS NULL AND alone THEN 'exercised' WHEN impl_files IS NULL THEN 'untagged' WHEN test_files IS NULL OR NOT coalesce(ok, false) THEN 'impl-only' ELSE 'verified' END AS status, coalesce(impl_files, '') AS impl_files, coalesce(test_files, '') AS test_files FROM cov) x")
def coverage_in_full(spark, d):
    return covered(findings.coverage(P.graph(spark, d).stored(), P.results(spark, d), P.evidence(spark, d)))
