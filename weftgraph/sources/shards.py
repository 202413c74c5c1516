"""Trace shards: JSON lines to tests, skipped tests and diagnostics, and their attribution to nodes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import inherited_tags

VERSION = 1
HITS = "array<struct<file:string,fn:string>>"


def shard_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """shard (its path) and line."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("shard"), F.col("value").alias("line"))


def _is(value: str, kind: str) -> str:
    return f"coalesce(schema_of_variant({value}), '') = '{kind}'"


def parse(lines: DataFrame) -> DataFrame:
    """shard, record (meta, test, skipped or corrupted) and the record's fields.

    Blank lines are ignored.  A line that is no JSON object of a known kind, or
    whose fields have another type than the format's, is corrupted.
    """
    text = lambda p: f"try_variant_get(v, '$.{p}', 'string')"
    at = lambda p: f"try_variant_get(v, '$.{p}', 'variant')"
    hits = "try_variant_get(v, '$.hits', 'array<variant>')"
    each = " AND ".join(_is(f"try_variant_get(h, '$.{f}', 'variant')", "STRING") for f in ("file", "fn"))
    fine = {
        "meta": f"schema_of_variant({at('schemaVersion')}) RLIKE '^(BIGINT|DECIMAL|DOUBLE)'",
        "test": f"{_is(at('testName'), 'STRING')} AND {_is(at('testFile'), 'STRING')} AND {_is(at('passed'), 'BOOLEAN')} AND forall({hits}, h -> {each})",
        "skipped": " AND ".join(_is(at(p), "STRING") for p in ("testName", "testFile", "reason")),
    }
    kind = " ".join(f"WHEN {text('kind')} = '{k}' AND ({ok}) THEN '{k}'" for k, ok in fine.items())
    return (
        lines.filter(F.trim(F.regexp_replace("line", r"\s", "")) != "")
        .withColumn("v", F.try_parse_json("line"))
        .select(
            "shard",
            F.expr(f"CASE {kind} ELSE 'corrupted' END").alias("record"),
            F.expr("try_variant_get(v, '$.schemaVersion', 'double')").alias("version"),
            F.expr(text("testFile")).alias("test_file"),
            F.expr(text("testName")).alias("test_name"),
            F.expr("coalesce(try_variant_get(v, '$.suitePath', 'array<string>'), array())").alias("suite_path"),
            F.expr("try_variant_get(v, '$.passed', 'boolean')").alias("passed"),
            F.expr(f"array_sort(array_distinct(try_variant_get(v, '$.hits', '{HITS}')))").alias("hits"),
            F.expr("array_sort(map_entries(coalesce(try_variant_get(v, '$.hashes', 'map<string,string>'), map())))").alias("hashes"),
            F.expr(text("reason")).alias("reason"),
        )
    )


def normalise(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct tests, distinct skipped records, and one row of diagnostics.

    Records of a shard with another schema version are left out and the shard is
    counted; its corrupted lines still count.  Order of shards and lines does not matter.
    """
    other = records.filter((F.col("record") == "meta") & (F.col("version") != VERSION)).select("shard").distinct()
    known = records.join(other, "shard", "anti")
    tests = known.filter("record = 'test'").select("test_file", "test_name", "suite_path", "passed", "hits", "hashes").distinct()
    skipped = known.filter("record = 'skipped'").select("test_file", "test_name", "reason").distinct()
    counts = records.agg(F.count_if(F.col("record") == "corrupted").alias("corrupted"), F.countDistinct("shard").alias("shards"))
    unknown = records.agg(F.countDistinct(F.when((F.col("record") == "meta") & (F.col("version") != VERSION), F.col("shard"))).alias("unknown_schema"))
    return tests, skipped, counts.crossJoin(unknown)  # two single rows


def symbol_names(symbols: DataFrame) -> DataFrame:
    """``symbols(path, name, id)`` whose name is unique in its file."""
    return symbols.groupBy("path", "name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1").select("path", "name", "id")


def hit_pairs(tests: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """req_id and node_id of what passed, tagged tests hit, repeats included; works on a stream of tests too, the other tables at rest."""
    tagged = tests.filter("passed").withColumn("req_ids", inherited_tags(F.col("test_name"), F.col("suite_path"))).filter(F.size("req_ids") > 0)
    hits = tagged.select("req_ids", F.explode("hits").alias("hit")).select("req_ids", F.col("hit.file").alias("path"), F.col("hit.fn").alias("name"))
    known = hits.join(files.select("path").distinct(), "path").join(symbol_names(symbols), ["path", "name"], "left")
    return known.select(F.explode("req_ids").alias("req_id"), F.coalesce("id", F.concat(F.lit("file:"), "path")).alias("node_id"))


def ingest(tests: DataFrame, symbols: DataFrame, files: DataFrame, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Evidence of passed, tagged tests.

    ``files(path)`` are scanned; ``existing(path)`` are there though not scanned.
    A hit is its symbol if the name is unique in the file, else the file.
    Returns evidence (req_id, node_id, grain), tests (req_id, test_file,
    test_name), hashes (node_id, hash; the last test in order wins) and dangling
    (one row: hits on files that are gone).
    """
    tagged = tests.filter("passed").withColumn("req_ids", inherited_tags(F.col("test_name"), F.col("suite_path"))).filter(F.size("req_ids") > 0)
    by_req = tagged.select(F.explode("req_ids").alias("req_id"), "test_file", "test_name").distinct()
    hits = tagged.select("req_ids", "test_file", "test_name", "hashes", F.explode("hits").alias("hit")).select("*", F.col("hit.file").alias("path"), F.col("hit.fn").alias("name"))
    scanned = files.select("path").distinct()
    known = hits.join(scanned, "path", "semi").join(symbol_names(symbols), ["path", "name"], "left")
    known = known.withColumn("node_id", F.coalesce("id", F.concat(F.lit("file:"), "path"))).withColumn("grain", F.when(F.col("id").isNull(), "file").otherwise("symbol"))
    gone = hits.join(scanned, "path", "anti")
    if existing is not None:
        gone = gone.join(existing.select("path").distinct(), "path", "anti")
    traced = known.withColumn("entry", F.filter("hashes", lambda e: e["key"] == F.col("path"))).filter(F.size("entry") > 0)
    order = F.struct("test_file", "test_name", "hashes")
    return {
        "evidence": known.select(F.explode("req_ids").alias("req_id"), "node_id", "grain").distinct(),
        "tests": by_req,
        "hashes": traced.groupBy("node_id").agg(F.max_by(F.col("entry")[0]["value"], order).alias("hash")),
        "dangling": gone.agg(F.count("*").alias("dangling")),
    }


def has_shards(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether any shard is there; nothing of it is read."""
    try:
        return bool(spark.read.text(paths).inputFiles())
    except AnalysisException:
        return False


def is_excluded(path: Column) -> Column:
    """Paths that a trace leaves out: outside the root, installed packages and tests."""
    # Fixed value: names of test files.
    test = r"\.(?:test|spec)\.[cm]?[jt]sx?$"
    return path.startswith("..") | path.startswith("/") | F.array_contains(F.split(path, "/"), "node_modules") | path.rlike(test)


def empty_trace(spark: SparkSession) -> dict[str, DataFrame]:
    """What ``ingest`` returns where there is no shard."""
    schemas = {"evidence": "req_id string, node_id string, grain string", "tests": "req_id string, test_file string, test_name string", "hashes": "node_id string, hash string"}
    return {name: spark.createDataFrame([], schema) for name, schema in schemas.items()} | {"dangling": spark.createDataFrame([(0,)], "dangling long")}
