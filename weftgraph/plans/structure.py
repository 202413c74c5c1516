"""Queries over nested Markdown, declarations, star exports, editing, second builds, ordered files and SQL functions, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql as sql_functions
from ..graph import Graph, dealt, shared_folder, stored
from ..operators import canonical, evidence, extract, plan, resolve, rewrite, snapshot
from ..operators.build import build
from ..operators.declarations import declarations
from ..operators.stars import providers
from ..sources import lock as locks
from ..sources import ordered, results
from ..sources.fragments import Fragments
from ..streaming import classes
from . import projection as P
from .catalog import query
from .more import num
from .texts import SHARDS, code, gathered, shard_lines, specs

SHORT = "substr(sha256({}), 1, 16)".format


def lines(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# Nested and continued list items, quotes, fences and indented code: an ordered item a customer, 20 a file.
def outlines(spark, d) -> DataFrame:
    k, pad = num("c_custkey"), F.repeat(F.lit(" "), F.length(num("c_custkey")) + 2)
    item = lines(
        k, ". **REQ-", k, "**: ", F.col("c_name"), "\n", pad, "`(depends_on: X-1)` on (depends_on: REQ-", (F.col("c_custkey") + 1).cast("string"), ")\n",
        pad, "- SUB-", k, ": in\n\n", pad, "  tail (depends_on: X-2)\n", pad, "> - OUT-", k, ": quoted (depends_on: X-3)\n\n", pad, "```\n", pad, "- NO-", k, ": code\n", pad, "```",
    )
    path = lines("specs/q", F.floor(F.col("c_custkey") / 20).cast("string"), ".md")
    return gathered(P.table(spark, d, "customer").select(path.alias("key"), F.col("c_custkey").alias("k"), item.alias("line")), "key", "---\ntitle: T\n---\n")


OUT = """, own AS (SELECT c_custkey AS k, 'specs/q' || (c_custkey // 20) || '.md' AS file_path, c_name, 'REQ-' || c_custkey || ': ' || c_name || chr(10) || '(depends_on: X-1) on (depends_on: REQ-' || (c_custkey + 1) || ')' AS label FROM customer)"""


@query(
    f"SELECT 'REQ-' || k AS id, file_path, label, {SHORT('''\'REQ-\' || k || \': \' || c_name || chr(10) || \'on SUB-\' || k || \': intail OUT-\' || k || \': quoted - NO-\' || k || \': code\'''')} AS content_hash FROM own "
    f"UNION ALL SELECT 'SUB-' || k, file_path, 'SUB-' || k || ': in', {SHORT('''\'SUB-\' || k || \': intail\'''')} FROM own "
    f"UNION ALL SELECT 'OUT-' || k, file_path, 'OUT-' || k || ': quoted (depends_on: X-3)', {SHORT('''\'OUT-\' || k || \': quoted\'''')} FROM own",
    OUT,
)
def outline_requirements(spark, d):
    return extract.requirements(outlines(spark, d)).select("id", "file_path", "label", "content_hash")


@query("SELECT 'REQ-' || k AS source, 'depends_on' AS kind, 'REQ-' || (k + 1) AS target, 'valid' AS status FROM own", OUT)
def outline_annotations(spark, d):
    return extract.annotations(outlines(spark, d)).select("source", "kind", "target", "status")


# Headings that are requirements, with annotations on the outer lines of their first paragraph.
def sections(spark, d) -> DataFrame:
    k = num("s_suppkey")
    body = lines("# Doc\r\n### Requirement ", k, ": ", F.col("s_name"), " ##\r\n\r\nfirst (depends_on: A-1)\r\nmid (depends_on: B-1)\r\nlast (derives_from: C-", k, ")\r\n\r\n#### Detail\r\n(depends_on: D-1)\r\n### Other\r\n- FR-", k, ": item\r\n")
    return P.table(spark, d, "supplier").select(lines("specs/s", k, ".md").alias("path"), body.alias("text"))


@query(
    f"SELECT 'Requirement-' || s_suppkey AS id, 'Requirement ' || s_suppkey || ': ' || s_name AS label, {SHORT('''\'### Requirement \' || s_suppkey || \': \' || s_name || \' ##\' || chr(10) || chr(10) || \'first\' || chr(10) || \'mid\' || chr(10) || \'last\' || chr(10) || chr(10) || \'#### Detail\' || chr(10) || \'(depends_on: D-1)\'''')} AS content_hash, 2 AS line FROM supplier "
    f"UNION ALL SELECT 'FR-' || s_suppkey, 'FR-' || s_suppkey || ': item', {SHORT('''\'FR-\' || s_suppkey || \': item\'''')}, 11 FROM supplier"
)
def section_requirements(spark, d):
    return extract.requirements(sections(spark, d)).select("id", "label", "content_hash", "line")


@query("SELECT 'Requirement-' || s_suppkey AS source, kind, target || CASE WHEN target = 'C-' THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS target FROM supplier, (VALUES ('depends_on', 'A-1'), ('derives_from', 'C-')) v(kind, target)")
def section_annotations(spark, d):
    return extract.annotations(sections(spark, d)).select("source", "kind", "target")


# Tasks in tasks, with a list of 150 requirements.
def task_files(spark, d) -> DataFrame:
    k = num("s_suppkey")
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.concat(i.cast("string"), F.lit(".2"))), ", ")
    body = lines("- [ ] T", k, " do @impl(A-1, B-", k, ")\n  more [FR-", k, "]\n  - [x] T", k, "9 sub\n    @impl(C-1)\n  - note\n    - deep [ns/FR-2]\n- [x] 7 list\n  - _Requirements: ", many, "_\n- 8 no task @impl(D-1)\n")
    return P.table(spark, d, "supplier").select(lines("specs/t", k, "/tasks.md").alias("path"), body.alias("text"))


@query(
    "SELECT 'T' || s_suppkey || more AS source, kind, CASE target WHEN 'B-' THEN 'B-' || s_suppkey WHEN 'FR-' THEN 'FR-' || s_suppkey ELSE target END AS target, CAST(NULL AS VARCHAR) AS target_space FROM supplier, "
    "(VALUES ('', 'implements', 'A-1'), ('', 'implements', 'B-'), ('', 'verifies', 'FR-'), ('', 'verifies', 'ns/FR-2'), ('9', 'implements', 'C-1')) v(more, kind, target) "
    "UNION ALL SELECT '7', 'verifies', 'Requirement-' || (range + 1), 'requirement' FROM supplier, range(150)"
)
def task_tags(spark, d):
    return extract.tasks(task_files(spark, d))[1].select("source", "kind", "target", "target_space")


@query(f"SELECT 'T' || s_suppkey AS id, 'spec-kit' AS convention, {SHORT('''\'[ ] T\' || s_suppkey || \' do @impl(A-1, B-\' || s_suppkey || \')\' || chr(10) || \'more [FR-\' || s_suppkey || \'][x] T\' || s_suppkey || \'9 sub\' || chr(10) || \'@impl(C-1)notedeep [ns/FR-2]\'''')} AS content_hash FROM supplier")
def task_nodes(spark, d):
    return extract.tasks(task_files(spark, d))[0].filter("id not like '%9' and id like 'T%' or id like 'T%9' and length(file_path) - length(id) >= 15").filter(F.concat(F.lit("specs/t"), F.substring(F.col("id"), 2, 20), F.lit("/tasks.md")) == F.col("file_path")).select("id", "convention", "content_hash")


# Declarations: lists over lines, patterns, several declarators, members; nothing out of comments, strings and templates.
def sources(spark, d) -> DataFrame:
    k = num("o_orderkey")
    body = lines(
        "/* export const ghost = 1\nimport './o1' */\nconst t = `${ `export const g2 = ${1}` }`, s = '// @impl X-1'\n// @impl REQ-", k, "\n\nexport const { a", k, ", b: c", k, " } = t, [d", k, " = 2] = s,\n  e", k, " = { x: [1] }\nfunction f", k,
        "(): { y: 1 } { return 1 }\nexport {\n  f", k, " as g", k, ", // one, two\n  s,\n}\nexport default class K extends B<{ z: 1 }> {\n  x = 1\n  // @impl REQ-7\n  run() { }\n  arrow = () => 2\n}\nexport * as ns from './o", (F.col("o_orderkey") + 1).cast("string"), "'\n",
    )
    return P.table(spark, d, "orders").select(lines("src/o", k, ".ts").alias("path"), body.alias("text"))


NAMES = ", named AS (SELECT o_orderkey AS k, CASE WHEN name IN ('s', 'default', 'default.run', 'default.arrow') THEN name ELSE name || o_orderkey END AS name, a, b FROM orders, (VALUES ('a', 4, 7), ('c', 4, 7), ('d', 4, 7), ('e', 4, 7), ('g', 8, 8), ('s', 1, 3), ('default', 13, 18), ('default.run', 15, 16), ('default.arrow', 17, 17)) v(name, a, b))"


@query('SELECT \'symbol:src/o\' || k || \'.ts#\' || name AS id, a AS "start", b AS "end" FROM named', NAMES)
def code_declarations(spark, d):
    return extract.symbols(sources(spark, d)).select("id", "start", "end")


@query("SELECT 'src/o' || o_orderkey || '.ts' AS path, CASE WHEN i = 0 THEN 'REQ-' || o_orderkey ELSE 'REQ-7' END AS req_id, CASE WHEN name IN ('default.run') THEN name ELSE name || o_orderkey END AS symbol FROM orders, (VALUES (0, 'a'), (0, 'c'), (0, 'd'), (0, 'e'), (1, 'default.run')) v(i, name)")
def declared_tags(spark, d):
    declared = stored(declarations(sources(spark, d)))
    tags, symbols = extract.implementation_tags(declared), extract.symbols(declared)
    held = canonical.enclosing_symbols(tags.select("path", "line").distinct(), symbols)
    return tags.join(held, ["path", "line"]).select("path", "req_id", F.element_at(F.split("symbol_id", "#"), -1).alias("symbol"))


@query("SELECT 'src/o' || a.o_orderkey || '.ts' AS path, 'ns' AS name, substr(sha256('src/o' || b.o_orderkey || '.ts' || chr(0) || '*' || chr(0) || 'ns'), 1, 16) AS content_hash FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def code_reexports(spark, d):
    return extract.reexports(sources(spark, d)).select("path", "name", "content_hash")


# Star exports: a tree with short cuts and cycles; the nine first files declare a name each.
@query(
    "SELECT 'b' || origin AS path, 'n' || pos AS name, 'b' || min(trail[2]) AS target FROM ways WHERE pos < 10 AND pos <> origin GROUP BY origin, pos HAVING count(*) = 1",
    """, star AS (SELECT o_orderkey AS a, o_orderkey // 64 AS b FROM orders WHERE o_orderkey > 1 UNION SELECT o_orderkey, o_orderkey // 65 FROM orders WHERE o_orderkey % 7 = 0 UNION SELECT o_orderkey // 64, o_orderkey FROM orders WHERE o_orderkey % 11 = 0
    ), walk AS (SELECT DISTINCT a AS origin, a AS pos, [a] AS trail FROM star UNION ALL SELECT w.origin, s.b, list_append(trail, s.b) FROM walk w JOIN star s ON s.a = w.pos WHERE NOT list_contains(trail, s.b)
    ), ways AS (SELECT * FROM walk)""",
)
def star_exports(spark, d):
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    near, far = F.floor(F.col("k") / 64), F.floor(F.col("k") / 65)
    steps = o.filter("k > 1").select(F.col("k").alias("a"), near.alias("b")).union(o.filter("k % 7 = 0").select("k", far)).union(o.filter("k % 11 = 0").select(near, "k"))
    b = lambda c: F.concat(F.lit("b"), F.col(c).cast("string"))
    own = spark.range(10).select(b("id").alias("path"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    return providers(own, steps.select(b("a").alias("path"), b("b").alias("target")))


# Editing: definitions split and merged in each file, line ends kept.
def edited(spark, d) -> DataFrame:
    k, end = num("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, "\r\n").otherwise("\n")
    body = F.concat(F.lit("# T"), end, F.lit("- A-1: old"), end, F.lit("- B-"), k, F.lit(": x (depends_on: A-1)"), end, F.lit("last"))
    return P.table(spark, d, "supplier").select(lines("specs/e", k, ".md").alias("path"), body.alias("text"))


ENDS = ", ends AS (SELECT s_suppkey AS k, 'specs/e' || s_suppkey || '.md' AS path, CASE WHEN s_suppkey % 2 = 0 THEN chr(13) ELSE '' END || chr(10) AS e FROM supplier)"
TODO = ": (TODO: describe this requirement)"


@query(f"SELECT path, '# T' || e || '- B-' || k || ': x (depends_on: A-1)' || e || 'last' || e || '- A-2{TODO}' || e || '- A-3{TODO}' AS text FROM ends", ENDS)
def split_specs(spark, d):
    return rewrite.split_definition(edited(spark, d), "A-1", ["A-2", "A-3"])


@query(f"SELECT path, '# T' || e || CASE WHEN k = 5 THEN '' ELSE '- B-' || k || ': x (depends_on: A-1)' || e END || 'last' || e || '- C-1{TODO}' AS text FROM ends", ENDS)
def merged_specs(spark, d):
    return rewrite.merge_definitions(edited(spark, d), ["A-1", "B-5"], "C-1")


@query("SELECT path, line, CASE WHEN line = 2 THEN '- A-1: old' ELSE '- B-' || k || ': x (depends_on: A-1)' END AS before, CASE WHEN line = 2 THEN '- A-9: old' ELSE '- B-' || k || ': x (depends_on: A-9)' END AS after FROM ends, (VALUES (2), (3)) v(line)", ENDS)
def rename_lines(spark, d):
    return rewrite.rename_changes(edited(spark, d), "A-1", "A-9")


# Plans: parentheses in paths, nested headers, loose paths where no section names any.
def loose_plans(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    n = lambda by: (k * 37 + by).cast("string")
    listed = lines("Files: app/(auth)/o", n(1), ".ts (new), b (x)/c.ts\n- d/(e)/f.ts (one) (two)\nFiles: ignored.ts\n- g.ts:h(i)\n")
    loose = lines("See src/o", n(1), ".ts, (src/o", n(2), ".ts) and src/none.ts:1 or src/o", n(3), ".tsx.\n")
    return P.table(spark, d, "supplier").select(num("s_suppkey").alias("plan"), F.when(k % 2 == 0, listed).otherwise(loose).alias("text"))


@query(
    "SELECT CAST(s_suppkey AS VARCHAR) AS plan, CASE WHEN i = 0 THEN 'app/(auth)/o' || (s_suppkey * 37 + 1) || '.ts' WHEN i = 1 THEN 'b (x)/c.ts' WHEN i = 2 THEN 'd/(e)/f.ts (one)' ELSE 'g.ts:h' END AS path, CASE WHEN i < 2 THEN 1 WHEN i = 2 THEN 2 ELSE 4 END AS line FROM supplier, (VALUES (0), (1), (2), (3)) v(i) WHERE s_suppkey % 2 = 0 "
    "UNION ALL SELECT CAST(s_suppkey AS VARCHAR), f.file_path, 1 FROM supplier, (VALUES (1), (2)) v(i) JOIN nodes f ON f.kind IN ('file', 'test') WHERE s_suppkey % 2 = 1 AND f.file_path = 'src/o' || (s_suppkey * 37 + i) || '.ts'"
)
def plan_names(spark, d):
    return plan.entries(loose_plans(spark, d), P.graph(spark, d)).select("plan", F.concat_ws(":", "path", "symbol").alias("path"), "line")


# A second build: a seventh of the code and one specification have changed since.
@query("SELECT 'declarations' AS what, 0 AS generation, count(*) AS files FROM orders UNION ALL SELECT 'declarations', 1, count(*) FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'blocks', 0, count(DISTINCT c_custkey // 20) FROM customer UNION ALL SELECT 'blocks', 1, 1")
def build_again(spark, d):
    files = specs(spark, d).unionByName(code(spark, d))
    number = F.regexp_extract("path", r"^src/o(\d+)\.ts$", 1).try_cast("long")
    changed = files.withColumn("text", F.when((number % 7 == 0) | (F.col("path") == "specs/p1.md"), F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    kept = Fragments(f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}")
    build(files, kept=kept)
    build(changed, kept=kept)
    counted = [kept.table(spark, name).filter("kind in ('document', 'file')").groupBy("generation").agg(F.count("*").alias("files")).select(F.lit(name).alias("what"), "generation", "files") for name in ("blocks", "declarations")]
    return counted[0].unionByName(counted[1])


@query("SELECT 'REQ-' || c_custkey AS id, CASE WHEN c_custkey // 20 = 1 AND c_custkey = 25 THEN 'later' ELSE 'first' END AS last_reconciled FROM customer")
def reconciled(spark, d):
    """The lock of a second build over a changed requirement: all other entries keep their time."""
    files = specs(spark, d)
    folder = f"{shared_folder(spark)}/lock-{uuid.uuid4().hex}"
    changed = files.withColumn("text", F.replace("text", F.lit("**REQ-25**: "), F.lit("**REQ-25**: new ")))
    for text, now in ((files, "first"), (changed, "later")):
        graph, warnings = build(text)
        snapshot.reconcile(graph.stored(), warnings, folder, now)
    return locks.read_lock(spark, folder).filter("id like 'REQ-%'").select("id", "last_reconciled")


# Reports with suites in suites.
@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'REQ-' || event_id ELSE 'ns/REQ-' || user_id END AS req_id, event_type <> 'error' AS passed FROM events")
def deep_results(spark, d):
    e = P.table(spark, d, "events").select("event_id", "user_id", "event_type")
    own = F.when(F.col("event_id") % 3 == 0, lines("[REQ-", num("event_id"), "]")).otherwise("t")
    case = lines("<testcase name='", own, "'>", F.when(F.col("event_type") == "error", "<error/>").otherwise("<![CDATA[<error/>]]>"), "</testcase>")
    text = lines("<testsuites>", F.repeat(F.lit("<testsuite name='s'>"), 5), "<testsuite name='[ns/REQ-", num("user_id"), "]'>", F.repeat(F.lit("<testsuite name='u'>"), 6), case, F.repeat(F.lit("</testsuite>"), 12), "</testsuites>")
    return results.read_results(e.select(text.alias("text"))).select("req_id", "passed")


# Evidence: off the graph, and suggestions that a claim above or below suppresses.
@query("SELECT count(*) FILTER (n.id IS NULL AND f.id IS NOT NULL) AS moved, count(*) FILTER (n.id IS NULL AND f.id IS NULL) AS lost FROM (SELECT DISTINCT req_id, replace(node_id, 'file:', 'symbol:') || '#l' || (length(req_id) % 9) AS sid, node_id FROM evidence) e LEFT JOIN nodes n ON n.id = sid LEFT JOIN nodes f ON f.id = e.node_id")
def off_graph_counts(spark, d):
    symbol = F.concat(F.replace("node_id", F.lit("file:"), F.lit("symbol:")), F.lit("#l"), (F.length("req_id") % 9).cast("string"))
    return evidence.off_graph(P.graph(spark, d), P.evidence(spark, d).select("req_id", symbol.alias("node_id")))


@query("SELECT 'suggested' AS class, 'FREE-' || p_partkey AS req_id, 'symbol:src/p' || p_partkey || '.ts#C.m' AS node_id FROM part WHERE p_partkey % 3 = 2 UNION ALL SELECT 'unexercised', 'FREE-' || p_partkey, 'symbol:src/p' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.ts#C' ELSE '.ts#C.m.x' END FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT 'corroborated', 'FREE-' || p_partkey, 'symbol:src/p' || p_partkey || '.ts#C' FROM part WHERE p_partkey % 3 = 0")
def suppressed_suggestions(spark, d):
    """A member a part is the only one that evidence of a requirement reaches; a task claims the requirement above it, below it, or not at all."""
    k = P.table(spark, d, "part").select("p_partkey")
    s = lambda tail: F.concat(F.lit("symbol:src/p"), num("p_partkey"), F.lit(".ts#" + tail))
    req, kind = F.concat(F.lit("FREE-"), num("p_partkey")), F.col("p_partkey") % 3
    claimed = F.when(kind == 0, s("C")).when(kind == 1, s("C.m.x"))
    edge = lambda a, b, what: F.struct(a.alias("source"), b.alias("target"), F.lit(what).alias("kind"))
    edges = k.select(F.inline(F.array(edge(s("C"), s("C.m"), "contains"), edge(s("C.m"), s("C.m.x"), "contains"), edge(claimed, req, "implements")))).filter("source is not null")
    # Whoever implements is a task, so the requirement counts as unclaimed and only the claim's place can suppress.
    node = lambda i, what: F.struct(i.alias("id"), F.lit(what).alias("kind"))
    nodes = k.select(F.inline(F.array(node(s("C"), "task"), node(s("C.m"), "symbol"), node(s("C.m.x"), "task"), node(req, "req"))))
    return evidence.classify(Graph(nodes, edges), k.select(req.alias("req_id"), s("C.m").alias("node_id"))).select("class", "req_id", "node_id")


# Ids: resolution by suffix, and references to colliding ids.
@query("SELECT DISTINCT 'FR-' || s_suppkey AS ref, CASE WHEN s_suppkey % 2 = 0 THEN 'a/x/FR-' || s_suppkey ELSE 'FR-' || s_suppkey END AS target, 'resolved' AS status FROM supplier")
def suffix_targets(spark, d):
    s = P.table(spark, d, "supplier")
    ids = s.filter("s_suppkey % 2 = 0").select(F.explode(F.array(lines("a/x/FR-", num("s_suppkey")), lines("b/x/FR-", num("s_suppkey")))).alias("id"), F.lit("p").alias("spec_dir")).withColumn("qualified_id", F.col("id"))
    refs = s.select(lines("FR-", num("s_suppkey")).alias("ref"), F.lit("q").alias("spec_dir"))
    return canonical.annotation_targets(refs, ids).select("ref", "target", "status")


@query(
    "SELECT 'doc:r' || s_suppkey || '.md' AS source, 'd' || s_suppkey || '/REQ-' || s_suppkey AS target, 'depends_on' AS kind FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'doc:r' || s_suppkey || '.md', 'REQ-' || s_suppkey, 'depends_on' FROM supplier WHERE s_suppkey % 2 = 1"
)
def remapped_references(spark, d):
    """Documents refer to an id that two directories define, one of them under the id's tail only, or that one does."""
    s, k = P.table(spark, d, "supplier"), num("s_suppkey")
    own = s.select(lines("specs/d", k, "/a.md").alias("path"), lines("- REQ-", k, ": one\n").alias("text"))
    again = s.filter("s_suppkey % 2 = 0").select(lines("specs/d", k, "/sub/b.md"), lines("- REQ-", k, ": same directory\n"))
    other = s.filter("s_suppkey % 2 = 0").select(lines("specs/z", k, "/b.md"), lines("text\n"))
    refers = s.select(lines("specs/r", k, ".md"), lines("---\ngraph:\n  depends_on: [", F.when(F.col("s_suppkey") % 2 == 0, lines("d", k, "/REQ-", k)).otherwise(lines("REQ-", k)), "]\n---\n"))
    graph, _ = build(own.union(again).union(other).union(refers))
    return graph.edges_of("depends_on").select("source", "target", "kind")


# Files in order.
@query("SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM nodes")
def ordered_nodes(spark, d):
    folder = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    ordered.write_ordered(P.graph(spark, d).nodes, ["id"], folder)
    return ordered.read_ordered(spark, folder).select("id", "place")


@query("SELECT source, target, kind, row_number() OVER (ORDER BY source, target, kind) - 1 AS place FROM edges")
def ordered_edges(spark, d):
    folder = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    ordered.write_ordered(P.graph(spark, d).edges, ["source", "target", "kind"], folder)
    return ordered.read_ordered(spark, folder).select("source", "target", "kind", "place")


# Counts kept up over a stream of shards.
@query(
    "SELECT 'g1' AS generation, node_id, count(*) AS n_reqs, CASE WHEN count(*) = 1 THEN 'exclusive' WHEN count(*) >= 5 THEN 'infrastructure' ELSE 'shared' END AS class, CASE WHEN count(*) = 1 THEN min(req_id) END AS req_id FROM ("
    "SELECT DISTINCT 'REQ-' || user_id AS req_id, CASE WHEN o_orderkey % 2 = 0 THEN 'symbol:src/o' || k || '.ts#f' ELSE 'file:src/o' || k || '.ts' END AS node_id FROM good JOIN orders ON o_orderkey = k AND o_orderkey % 10 < 8 WHERE passed) x GROUP BY node_id",
    SHARDS,
)
def streamed_classes(spark, d):
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    shard_lines(spark, d).repartition("shard").write.partitionBy("shard").text(f"{folder}/in")
    orders = P.table(spark, d, "orders").select("o_orderkey", P.path_of("o_orderkey", "src/o", ".ts").alias("path"))
    symbols = orders.filter("o_orderkey % 2 = 0").select("path", F.lit("f").alias("name"), F.concat(F.lit("symbol:"), "path", F.lit("#f")).alias("id"))
    counts = classes.count_requirements(classes.stream_whole_shards(spark, f"{folder}/in"), symbols, orders.filter("o_orderkey % 10 < 8"), "g1")
    classes.write_counts(counts, f"{folder}/out", f"{folder}/state").awaitTermination()
    return classes.node_classes(classes.read_counts(spark, f"{folder}/out"))


# The same from SQL, with patterns of one's own.
@query("SELECT 'STORY-' || s_suppkey AS id, 'Story STORY-' || s_suppkey || ': ' || s_name AS label FROM supplier")
def sql_headings(spark, d):
    sql_functions.register(spark)
    k = num("s_suppkey")
    files = P.table(spark, d, "supplier").select(lines("specs/s", k, ".md").alias("path"), lines("# Story STORY-", k, ": ", F.col("s_name"), "\n- STORY-1: item\n").alias("text"))
    return spark.sql("SELECT regexp_extract(b.text, '^Story ([A-Z]+-[0-9]+)', 1) AS id, b.text AS label FROM {files} f, LATERAL markdown_blocks(f.path, f.text, '^Story ([A-Z]+-[0-9]+)') b WHERE b.section IS NOT NULL", files=files)


@query("SELECT 'src/o' || k || '.ts' AS path, name FROM named WHERE name NOT LIKE 'default.%'", NAMES)
def sql_declarations(spark, d):
    sql_functions.register(spark)
    return spark.sql("SELECT c.path AS path, c.name AS name FROM {files} f, LATERAL code_declarations(f.path, f.text) c WHERE c.kind = 'symbol' AND c.owner IS NULL", files=dealt(sources(spark, d)))


@query("SELECT '[REQ-' || o_custkey || '] t' AS title, 'REQ-' || o_custkey AS tag, true AS said FROM orders")
def sql_ids(spark, d):
    sql_functions.register(spark)
    titles = P.table(spark, d, "orders").select(lines("[REQ-", num("o_custkey"), "] t").alias("title"))
    return spark.sql("SELECT title, title_tags(title)[0] AS tag, mentions(title, title_tags(title)[0]) AS said FROM {titles}", titles=titles)


# Resolution through manifests and configurations: a package a customer, a chain of configurations over all suppliers.
def packages(spark, d) -> DataFrame:
    k, c = num("c_custkey"), F.col("c_custkey") % 5
    base = lines("src/p", k)
    manifest = F.when(c == 0, '{"types": "./lib/t.d.ts", "main": "m.js"}').when(c == 1, '{"main": "./m.js"}').when(c == 2, '{"types": "gone.d.ts"}').when(c == 3, "{broken")
    file = lambda end, text="export {}": F.struct(F.concat(base, F.lit(end)).alias("path"), F.lit(text).alias("text"))
    rows = F.array(file("/lib/t.d.ts"), file("/m.ts"), file("/m.tsx"), file("/index.ts"), file("/ui.tsx"), file("/data.json", "{}"), F.struct(F.concat(base, F.lit("/package.json")).alias("path"), manifest.alias("text")))
    return P.table(spark, d, "customer").select(F.inline(rows)).filter("text is not null")


@query(
    "SELECT 'src/main.ts' AS path, './p' || c_custkey || s AS spec, 'src/p' || c_custkey || CASE WHEN s = '/ui.js' THEN '/ui.tsx' WHEN c_custkey % 5 = 0 THEN '/lib/t.d.ts' WHEN c_custkey % 5 = 1 THEN '/m.ts' ELSE '/index.ts' END AS target FROM customer, (VALUES (''), ('/'), ('/ui.js')) v(s)"
)
def package_imports(spark, d):
    ends = F.explode(F.array(F.lit(""), F.lit("/"), F.lit("/ui.js"), F.lit("/data.json"), F.lit("/none"))).alias("s")
    specs_ = P.table(spark, d, "customer").select("c_custkey", ends).select(F.lit("src/main.ts").alias("path"), lines("./p", num("c_custkey"), F.col("s")).alias("spec"))
    return resolve.targets(specs_, packages(spark, d), resolve.Options(jsx=True))


@query(
    "SELECT 'c/' || s_suppkey || '.json' AS path, (SELECT max(b.s_suppkey) FROM supplier b WHERE b.s_suppkey <= a.s_suppkey AND b.s_suppkey % 10 IN (3, 5)) % 10 IS NOT DISTINCT FROM 3 AS jsx, "
    "(SELECT count(*) FROM supplier b WHERE b.s_suppkey <= a.s_suppkey AND b.s_suppkey % 7 = 2) > 0 AS allow_js, false AS resolve_json FROM supplier a"
)
def config_options(spark, d):
    """Each configuration extends the one before: jsx is set by every third of ten and taken back by every fifth."""
    s = F.col("s_suppkey")
    own = F.when(s % 10 == 3, '"jsx": "React",').when(s % 10 == 5, '"jsx": "no",').otherwise("")
    more = F.when(s % 7 == 2, '"allowJs": true,').otherwise("")
    body = lines("// c\n{ \"extends\": \"./", (s - 1).cast("string"), "\", /* x */ \"compilerOptions\": {", own, more, "}, }")
    return resolve.effective_options(P.table(spark, d, "supplier").select(lines("c/", num("s_suppkey"), ".json").alias("path"), body.alias("text")))
