"""Registered queries over the projected graph, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import stored
from ..operators import canonical, evidence, findings, snapshot, traverse
from . import projection as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Starts of the impact queries: one in the thick of the imports, two at the edge.
STARTS = ["file:src/o5.ts", "file:src/o2500.ts", "REQ-7"]
STALE_SQL = ", stale AS MATERIALIZED (SELECT DISTINCT h.node_id AS id FROM hashes h LEFT JOIN nodes n ON n.id = h.node_id WHERE n.content_hash IS DISTINCT FROM h.hash)"


#: Common tables that read themselves.
LOOPS = ("walk", "deep", "hop", "pwalk", "closed")


def query(sql: str | None, extra: str = ""):
    """Register a query under its function's name; ``sql`` follows those of the projection's tables that it reads, and ``extra``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = P.with_tables(extra, sql, any(f" {name} AS " in extra for name in LOOPS))
        return f

    return add


def starts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in STARTS], "id string")


def joined(column: str):
    return F.concat_ws(",", column).alias(column)


@query("SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def scan_kind_counts(spark, d):
    return canonical.kind_counts(P.graph(spark, d))


@query("SELECT source, target, kind, provenances FROM edges")
def canonical_edges(spark, d):
    return P.graph(spark, d).edges.select("source", "target", "kind", joined("provenances"))


@query("SELECT id, kind, file_path, id AS label FROM nodes")
def exported_nodes(spark, d):
    return canonical.exported(P.graph(spark, d))[0]


@query("SELECT source, target, kind, provenances FROM edges")
def exported_edges(spark, d):
    return canonical.exported(P.graph(spark, d))[1].select("source", "target", "kind", joined("provenances"))


@query("SELECT d.id AS source, x.id AS target, 'contains' AS kind FROM nodes d JOIN nodes x USING (file_path) WHERE d.kind = 'doc' AND x.kind IN ('req', 'task')")
def auto_contains(spark, d):
    return canonical.contains_edges(P.raw_nodes(spark, d)).select("source", "target", "kind")


@query("SELECT n.id AS id FROM nodes n WHERE kind = 'doc' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = n.id OR e.target = n.id)")
def orphan_docs(spark, d):
    return findings.orphan_docs(P.graph(spark, d))


COLLIDING = ", defs AS (SELECT 'FR-' || (c_custkey % 700) AS id, 'specs/n' || c_nationkey AS spec_dir FROM customer), multi AS (SELECT id FROM defs GROUP BY id HAVING count(DISTINCT spec_dir) > 1)"


def definitions(spark, d):
    return P.table(spark, d, "customer").select(F.concat(F.lit("FR-"), (F.col("c_custkey") % 700).cast("string")).alias("id"), P.path_of("c_nationkey", "specs/n", "").alias("spec_dir"))


@query("SELECT defs.id AS id, spec_dir, CASE WHEN multi.id IS NULL THEN defs.id ELSE spec_dir || '/' || defs.id END AS qualified_id FROM defs LEFT JOIN multi ON multi.id = defs.id", COLLIDING)
def qualified_ids(spark, d):
    return canonical.qualify(definitions(spark, d))


@query(
    "SELECT DISTINCT ref, refs.spec_dir AS spec_dir, CASE WHEN own.id IS NOT NULL THEN CASE WHEN multi.id IS NULL THEN own.id ELSE own.spec_dir || '/' || own.id END WHEN multi.id IS NOT NULL THEN NULL ELSE ref END AS target, "
    "CASE WHEN own.id IS NULL AND multi.id IS NOT NULL THEN 'ambiguous' ELSE 'resolved' END AS status FROM refs LEFT JOIN (SELECT DISTINCT * FROM defs) own ON own.id = ref AND own.spec_dir = refs.spec_dir LEFT JOIN multi ON multi.id = ref",
    COLLIDING + ", refs AS (SELECT DISTINCT 'FR-' || (s_suppkey * 7 % 800) AS ref, 'specs/n' || s_nationkey AS spec_dir FROM supplier)",
)
def annotation_targets(spark, d):
    refs = P.table(spark, d, "supplier").select(F.concat(F.lit("FR-"), (F.col("s_suppkey") * 7 % 800).cast("string")).alias("ref"), P.path_of("s_nationkey", "specs/n", "").alias("spec_dir")).distinct()
    return canonical.annotation_targets(refs, canonical.qualify(definitions(spark, d)))


@query("SELECT source, target, kind, source || ' -> ' || target || ' (' || kind || ')' AS text FROM claims WHERE kind IN ('implements', 'verifies') AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = claims.target)")
def orphan_edges(spark, d):
    return findings.orphans(P.graph(spark, d))


@query("SELECT id AS req_id FROM nodes WHERE kind = 'req' AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.kind = 'implements' AND c.target = nodes.id)")
def uncovered_reqs(spark, d):
    return findings.uncovered(P.graph(spark, d))


@query("SELECT DISTINCT target AS req_id FROM claims WHERE kind = 'implements'")
def claimed_reqs(spark, d):
    return findings.claimed(P.graph(spark, d))


STATUS = "CASE WHEN impl_files IS NULL {rescue} THEN 'exercised' WHEN impl_files IS NULL THEN 'untagged' WHEN test_files IS NULL {failed} THEN 'impl-only' ELSE 'verified' END AS status"
FILES = "coalesce(impl_files, '') AS impl_files, coalesce(test_files, '') AS test_files"


def covered(df: DataFrame) -> DataFrame:
    return df.select("req_id", "status", joined("impl_files"), joined("test_files"))


@query(f"SELECT req_id, {STATUS.format(rescue='AND false', failed='OR NOT coalesce(ok, false)')}, {FILES} FROM cov")
def coverage_status(spark, d):
    return covered(findings.coverage(P.graph(spark, d).stored(), P.results(spark, d)))


@query(f"SELECT req_id, {STATUS.format(rescue='AND false', failed='')}, {FILES} FROM cov")
def coverage_without_results(spark, d):
    return covered(findings.coverage(P.graph(spark, d)))


@query(f"SELECT req_id, {STATUS.format(rescue='AND alone', failed='')}, {FILES} FROM cov")
def coverage_exercised(spark, d):
    return covered(findings.coverage(P.graph(spark, d), evidence=P.evidence(spark, d)))


@query("SELECT l.id AS node_id, n.kind AS kind, l.content_hash AS locked_hash, n.content_hash AS current_hash FROM lock l JOIN nodes n USING (id) WHERE l.content_hash <> n.content_hash")
def drift(spark, d):
    return findings.drift(P.graph(spark, d), P.lock(spark, d))


@query("SELECT id FROM lock WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = lock.id)")
def stale_lock_keys(spark, d):
    return findings.stale_keys(P.graph(spark, d), P.lock(spark, d))


ISSUES = """, cur AS MATERIALIZED (
  SELECT 'drift' AS category, l.id AS id, 'drift:["' || l.id || '","' || n.content_hash || '"]' AS key FROM lock l JOIN nodes n USING (id) WHERE l.content_hash <> n.content_hash
  UNION ALL SELECT 'orphan', source, 'orphan:' || source || ' -> ' || target || ' (' || kind || ')' FROM claims WHERE kind IN ('implements', 'verifies') AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = claims.target)
  UNION ALL SELECT 'uncovered', req_id, 'uncovered:' || req_id FROM cov WHERE impl_files IS NULL
  UNION ALL SELECT 'testfail', req_id, 'testfail:' || req_id FROM cov WHERE impl_files IS NOT NULL AND test_files IS NOT NULL AND NOT coalesce(ok, false)
), bnodes AS (
  SELECT id, CASE WHEN kind = 'req' AND CAST(substr(id, 5) AS BIGINT) % 22 = 0 THEN 'older' ELSE '' END || content_hash AS content_hash, kind FROM nodes WHERE kind = 'req'
), bclaims AS (
  SELECT * FROM claims WHERE NOT (kind = 'implements' AND coalesce(TRY_CAST(regexp_extract(source, 'o([0-9]+)', 1) AS BIGINT) % 4 = 0, false))
), base AS MATERIALIZED (
  SELECT 'drift:["' || l.id || '","' || n.content_hash || '"]' AS key FROM lock l JOIN bnodes n USING (id) WHERE l.content_hash <> n.content_hash
  UNION SELECT 'orphan:' || source || ' -> ' || target || ' (' || kind || ')' FROM bclaims WHERE kind IN ('implements', 'verifies') AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = bclaims.target)
  UNION SELECT 'uncovered:' || req_id FROM cov WHERE NOT EXISTS (SELECT 1 FROM bclaims b WHERE b.kind = 'implements' AND b.target = cov.req_id)
), checked AS (SELECT category, id, cur.key AS key, base.key IS NULL AS is_new FROM cur LEFT JOIN base ON base.key = cur.key)"""


def checked(spark, d):
    lock, g = P.lock(spark, d), P.graph(spark, d).stored()
    current = findings.issues(g, lock, results=P.results(spark, d))
    return findings.check(current, findings.issues(P.baseline(g), lock))


@query("SELECT category, id, key, is_new FROM checked", ISSUES)
def check_issues(spark, d):
    return checked(spark, d)


@query("SELECT count(*) AS n_issues, count(*) FILTER (is_new) AS n_new, count(*) FILTER (NOT is_new) AS n_suppressed, count(*) FILTER (is_new) = 0 AS passes FROM checked", ISSUES)
def check_summary(spark, d):
    return findings.summary(checked(spark, d))


REACH = f""", starts AS (SELECT unnest({STARTS!r}) AS id), origins AS (
  SELECT id FROM starts UNION SELECT s.id FROM nodes s JOIN nodes f ON f.file_path = s.file_path JOIN starts ON starts.id = f.id WHERE f.kind = 'file' AND s.kind = 'symbol'
), impl AS (SELECT DISTINCT target AS id FROM edges JOIN nodes n ON n.id = target WHERE edges.kind = 'implements' AND n.kind = 'req'
), hitting AS (SELECT DISTINCT source AS id FROM edges WHERE kind = 'exercises' AND target IN (SELECT id FROM origins)
), anyx AS (SELECT count(*) > 0 AS has FROM edges WHERE kind = 'exercises'
), full_edges AS MATERIALIZED (SELECT e.*, coalesce(n.kind = 'test', false) AS from_test, target IN (SELECT id FROM impl) AS ti, source IN (SELECT id FROM impl) AS si, target IN (SELECT id FROM hitting) AS th, has FROM edges e LEFT JOIN nodes n ON n.id = e.source, anyx
), steps AS MATERIALIZED (
  SELECT source AS a, 2 AS s, target AS b, CASE WHEN kind = 'exercises' THEN 0 WHEN kind = 'depends_on' AND provenances = 'inline-link' THEN 0 ELSE 2 END AS t FROM full_edges
  UNION ALL SELECT source, 1, target, CASE WHEN kind IN ('exercises', 'verifies') OR kind = 'depends_on' AND provenances = 'inline-link' THEN 0 ELSE 2 END FROM full_edges WHERE kind <> 'imports' AND (kind <> 'verifies' OR NOT ti AND (th OR NOT has))
  UNION ALL SELECT target, s, source, CASE WHEN kind = 'exercises' OR kind = 'depends_on' AND provenances = 'inline-link' THEN 0 WHEN kind IN ('verifies', 'imports') AND from_test THEN 1 ELSE 2 END FROM full_edges, (VALUES (1), (2)) v(s) WHERE kind <> 'contains' AND (kind <> 'exercises' OR NOT si)
  UNION ALL SELECT f.id, s, x.id, 2 FROM nodes f JOIN nodes x USING (file_path), (VALUES (1), (2)) v(s) WHERE f.kind = 'file' AND x.kind = 'symbol'
), walk AS (
  SELECT id, 2 AS state FROM starts UNION SELECT steps.b, steps.t FROM walk JOIN steps ON steps.a = walk.id AND steps.s = walk.state AND walk.state > 0
), visited AS MATERIALIZED (SELECT id, max(state) AS state FROM walk GROUP BY id
), above AS (SELECT DISTINCT e.source AS id FROM edges e JOIN nodes t ON t.id = e.target JOIN visited v ON v.id = t.id WHERE e.kind = 'contains' AND t.kind IN ('req', 'task')
), routed AS MATERIALIZED (
  SELECT DISTINCT CASE WHEN kind IN ('file', 'symbol', 'test') THEN 'file' ELSE kind END AS category, CASE WHEN kind IN ('file', 'symbol', 'test') THEN file_path ELSE id END AS value FROM nodes JOIN visited USING (id)
  UNION SELECT 'doc', id FROM above)"""


def reached(spark, d, *more: str):
    """The graph, with id, kind, file_path and ``more`` of its nodes, and what the starts reach."""
    g = P.graph(spark, d).stored("id", "kind", "file_path", *more)
    return g, traverse.reach(g, starts(spark))


@query("SELECT id, state FROM visited", REACH)
def impact_reach(spark, d):
    return reached(spark, d)[1]


@query("SELECT category, value FROM routed", REACH)
def impact(spark, d):
    return traverse.routed(*reached(spark, d))


@query("SELECT count(*) FILTER (category = 'doc') AS docs, count(*) FILTER (category = 'req') AS reqs, count(*) FILTER (category = 'file') AS files, count(*) FILTER (category = 'task') AS tasks FROM routed", REACH)
def impact_summary(spark, d):
    return traverse.impact_summary(*reached(spark, d))


@query("SELECT l.id AS node_id, n.kind AS kind, l.content_hash AS locked_hash, n.content_hash AS current_hash FROM lock l JOIN nodes n USING (id) WHERE l.content_hash <> n.content_hash AND id IN (SELECT id FROM visited UNION SELECT id FROM above)", REACH)
def impact_drift(spark, d):
    return traverse.impact_drift(*reached(spark, d, "content_hash"), P.lock(spark, d))


@query(
    "SELECT req_id, string_agg(DISTINCT p, ',' ORDER BY p) AS provenance FROM (SELECT CASE WHEN s.kind = 'req' THEN e.source ELSE e.target END AS req_id, CASE WHEN s.kind = 'req' THEN e.target ELSE e.source END AS other, CASE WHEN e.kind = 'exercises' THEN 'evidence' ELSE 'static' END AS p "
    "FROM edges e LEFT JOIN nodes s ON s.id = e.source LEFT JOIN nodes t ON t.id = e.target WHERE e.kind <> 'contains' AND (s.kind = 'req' OR t.kind = 'req')) x WHERE req_id IN (SELECT id FROM visited UNION SELECT id FROM above) AND other IN (SELECT id FROM visited UNION SELECT id FROM above) GROUP BY req_id",
    REACH,
)
def impact_provenance(spark, d):
    return traverse.requirement_provenance(*reached(spark, d)).select("req_id", joined("provenance"))


@query("SELECT DISTINCT n.id AS id FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'implements' AND n.kind = 'req' AND e.source IN (SELECT 'file:src/o' || range || '.ts' FROM range(40))")
def origin_reqs(spark, d):
    first = spark.range(40).select(F.concat(F.lit("file:src/o"), F.col("id").cast("string"), F.lit(".ts")).alias("id"))
    return traverse.origin_requirements(P.graph(spark, d), first)


@query("SELECT DISTINCT file_path FROM nodes WHERE kind = 'test' AND (id IN (SELECT id FROM visited) OR id IN (SELECT source FROM edges WHERE kind = 'verifies' AND target IN (SELECT id FROM visited)))", REACH)
def tests_to_run(spark, d):
    return traverse.tests_to_run(*reached(spark, d))


@query("SELECT id FROM starts UNION SELECT value FROM routed WHERE category IN ('req', 'doc') UNION SELECT 'file:' || value FROM routed WHERE category = 'file' UNION SELECT n.id FROM nodes n JOIN routed r ON r.value = n.file_path WHERE n.kind = 'symbol' AND r.category = 'file'", REACH)
def check_scope(spark, d):
    g, visited = reached(spark, d)
    return traverse.scope_ids(g, starts(spark), visited)


@query("SELECT 'symbol:src/o5.ts#l2' AS id UNION SELECT 'file:src/o6.ts' UNION SELECT b FROM hop", ", hop AS (SELECT target AS b FROM edges WHERE kind = 'imports' AND source IN ('symbol:src/o5.ts#l2', 'file:src/o6.ts') AND target LIKE 'symbol:%' UNION SELECT e.target FROM hop JOIN edges e ON e.source = hop.b AND e.kind = 'imports' AND e.target LIKE 'symbol:%')")
def import_closure(spark, d):
    first = spark.createDataFrame([("symbol:src/o5.ts#l2",), ("file:src/o6.ts",)], "id string")
    return traverse.import_closure(P.graph(spark, d), first)


@query("SELECT id FROM nodes WHERE file_path IN ('src/o5.ts', 'specs/n3.md') AND (kind <> 'test') UNION SELECT 'symbol:src/o7.ts#l1' WHERE 'symbol:src/o7.ts#l1' IN (SELECT id FROM nodes)")
def start_ids(spark, d):
    entries = spark.createDataFrame([("src/o5.ts", None), ("specs/n3.md", None), ("src/o7.ts", "l1"), ("src/o7.ts", "nope"), ("gone.ts", None)], "path string, symbol string")
    return traverse.start_ids(P.graph(spark, d), entries)[0]


@query("SELECT node_id, req_id FROM excl")
def exclusive_nodes(spark, d):
    return findings.exclusive(P.evidence(spark, d))


@query("SELECT DISTINCT id FROM stale", STALE_SQL)
def stale_nodes(spark, d):
    return evidence.stale_nodes(P.graph(spark, d), P.hashes(spark, d))


@query("SELECT req_id, node_id FROM evidence WHERE NOT EXISTS (SELECT 1 FROM stale s WHERE s.id = evidence.node_id)", STALE_SQL)
def fresh_evidence(spark, d):
    return evidence.fresh(P.evidence(spark, d), evidence.stale_nodes(P.graph(spark, d), P.hashes(spark, d)))


@query("SELECT req_id, string_agg(DISTINCT node_id, ',' ORDER BY node_id) AS stale_nodes FROM evidence WHERE node_id IN (SELECT id FROM stale) GROUP BY req_id", STALE_SQL)
def stale_by_requirement(spark, d):
    return evidence.stale_by_requirement(P.evidence(spark, d), evidence.stale_nodes(P.graph(spark, d), P.hashes(spark, d))).select("req_id", joined("stale_nodes"))


@query(
    "SELECT CASE WHEN c.source IS NULL THEN v.req_id ELSE v.node_id END AS source, CASE WHEN c.source IS NULL THEN v.node_id ELSE v.req_id END AS target, CASE WHEN c.source IS NULL THEN 'exercises' ELSE 'implements' END AS kind "
    "FROM evidence v LEFT JOIN edges c ON c.kind = 'implements' AND c.source = v.node_id AND c.target = v.req_id WHERE v.node_id IN (SELECT id FROM nodes)"
)
def evidence_edges(spark, d):
    return evidence.evidence_edges(P.graph(spark, d), P.evidence(spark, d)).select("source", "target", "kind")


@query(
    "SELECT CASE WHEN v.req_id IS NULL THEN 'unexercised' ELSE 'corroborated' END AS class, c.target AS req_id, c.source AS node_id, CAST(NULL AS BIGINT) AS n_reqs FROM edges c LEFT JOIN evidence v ON v.req_id = c.target AND v.node_id = c.source WHERE c.kind = 'implements' "
    "UNION ALL SELECT 'infrastructure', NULL, node_id, count(*) FROM evidence WHERE NOT EXISTS (SELECT 1 FROM edges c WHERE c.kind = 'implements' AND c.source = evidence.node_id) GROUP BY node_id HAVING count(*) >= 5 "
    "UNION ALL SELECT 'suggested', req_id, node_id, NULL FROM excl WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.kind = 'implements' AND c.target = excl.req_id)"
)
def evidence_classes(spark, d):
    return evidence.classify(P.graph(spark, d).stored(), stored(P.evidence(spark, d)))


LOCKED = """, deps AS (SELECT e.source, string_agg(e.target || '[' || e.provenances || ']', ';' ORDER BY e.target) AS depends_on FROM edges e JOIN nodes t ON t.id = e.target WHERE e.kind IN ('depends_on', 'derives_from') GROUP BY e.source
), newlock AS MATERIALIZED (SELECT n.id AS id, CASE WHEN kind = 'symbol' THEN NULL ELSE file_path END AS spec_file, content_hash, i.f AS impl, t.f AS tests, x.f AS exercises, deps.depends_on AS depends_on FROM nodes n
  LEFT JOIN (SELECT target, string_agg(DISTINCT source, ',' ORDER BY source) AS f FROM claims WHERE kind = 'implements' GROUP BY target) i ON i.target = n.id AND n.kind <> 'symbol'
  LEFT JOIN (SELECT target, string_agg(DISTINCT source, ',' ORDER BY source) AS f FROM claims WHERE kind = 'verifies' GROUP BY target) t ON t.target = n.id AND n.kind <> 'symbol'
  LEFT JOIN (SELECT source, string_agg(DISTINCT target, ',' ORDER BY target) AS f FROM edges WHERE kind = 'exercises' GROUP BY source) x ON x.source = n.id AND n.kind <> 'symbol'
  LEFT JOIN deps ON deps.source = n.id AND n.kind <> 'symbol' WHERE n.kind IN ('req', 'doc', 'symbol'))"""


def lock_rows(lock: DataFrame) -> DataFrame:
    text = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(",", c)).alias(c)
    deps = F.concat_ws(";", F.transform("depends_on", lambda x: F.concat(x["id"], F.lit("["), F.concat_ws(",", x["provenances"]), F.lit("]"))))
    return lock.select("id", "spec_file", "content_hash", text("impl"), text("tests"), text("exercises"), F.when(F.col("depends_on").isNotNull(), deps).alias("depends_on"))


@query("SELECT * FROM newlock", LOCKED)
def built_lock(spark, d):
    return lock_rows(snapshot.build_lock(P.graph(spark, d).stored(), "now"))


@query("SELECT * REPLACE (CASE WHEN id = 'REQ-9' THEN 'REQ-NINE' ELSE id END AS id) FROM newlock", LOCKED)
def renamed_lock(spark, d):
    return lock_rows(snapshot.rename_key(snapshot.build_lock(P.graph(spark, d).stored(), "now"), "REQ-9", "REQ-NINE"))


@query("SELECT * FROM newlock WHERE id <> 'REQ-9' UNION ALL SELECT * REPLACE ('REQ-' || s AS id, '' AS content_hash) FROM newlock, (VALUES ('9A'), ('9B')) v(s) WHERE id = 'REQ-9'".replace("SELECT * REPLACE ('REQ-' || s AS id, '' AS content_hash)", "SELECT 'REQ-' || s AS id, spec_file, '' AS content_hash, impl, tests, exercises, depends_on"), LOCKED)
def split_lock(spark, d):
    return lock_rows(snapshot.split_key(snapshot.build_lock(P.graph(spark, d).stored(), "now"), "REQ-9", ["REQ-9A", "REQ-9B"]))


from . import more, structure, texts  # noqa: E402, F401  register their queries here
