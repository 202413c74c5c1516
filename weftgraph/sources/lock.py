"""The lock on disk: versions in a folder, or one JSON object that maps ids to entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import LOCK_SCHEMA

VERSION = 1
META = "_meta"

# Field names of an entry.
FIELDS = {
    "specFile": "spec_file", "contentHash": "content_hash", "impl": "impl", "tests": "tests", "exercises": "exercises", "dependsOn": "depends_on", "lastReconciled": "last_reconciled",
}
ENTRY = "schemaVersion double, specFile string, contentHash string, impl array<string>, tests array<string>, exercises array<string>, dependsOn array<struct<id:string,provenances:array<string>>>, lastReconciled string"


def parse_lock(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of lock files in ``text``, and one row a file: version and status.

    A file that is no JSON object gives no entry and status malformed; no readable
    version, or none at all, is version 0; a later version than ours is read, with
    status newer.
    """
    parsed = files.select(F.from_json("text", T.MapType(T.StringType(), T.StructType.fromDDL(ENTRY))).alias("m"), F.try_parse_json("text").alias("v"))
    entries = parsed.select(F.explode("m").alias("id", "e")).filter(F.col("id") != META)
    raw = F.col("m")[META]["schemaVersion"]
    version = F.when((raw >= 0) & (raw == F.floor(raw)), raw).otherwise(0).cast("int")
    kind = F.coalesce(F.schema_of_variant("v"), F.lit(""))
    status = F.when(~kind.startswith("OBJECT"), "malformed").when(F.map_contains_key("m", F.lit(META)) & (raw.isNull() | (raw < 0) | (raw != F.floor(raw))), "bad-version").when(version > VERSION, "newer").otherwise("ok")
    told = parsed.select(F.coalesce(version, F.lit(0)).alias("version"), status.alias("status"))
    return entries.select("id", *[F.col(f"e.{a}").alias(b) for a, b in FIELDS.items()]), told


def lock_text(lock: DataFrame) -> DataFrame:
    """id and json: each entry as the text of its JSON object, fields without a value left out."""
    return lock.select("id", F.to_json(F.struct(*[F.col(b).alias(a) for a, b in FIELDS.items()])).alias("json"))


def write_lock(lock: DataFrame, folder: str, force: bool = False) -> int:
    """Write ``lock`` as the folder's next version; returns its number.

    A version shows up only as a whole, when its job commits, and earlier ones
    stay.  The id ``_meta`` is refused; so is a folder written by a later schema
    than ours, unless ``force``.
    """
    if not lock.filter(F.col("id") == META).isEmpty():
        raise ValueError(f"the id {META} is reserved")
    spark = lock.sparkSession
    held = versions(spark, folder)
    if not force and any(schema > VERSION for schema, _ in held):
        raise ValueError(f"{folder} was written by a later schema version")
    number = max((n for _, n in held), default=-1) + 1
    lock_text(lock).write.json(f"{folder}/schema={VERSION}/version={number}")
    return number


def versions(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """schema and version of what the folder holds; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    if system.exists(path):
        for status in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/schema=*/version=*/_SUCCESS")) or []:
            at = status.getPath().getParent()
            out.append((int(at.getParent().getName().split("=")[1]), int(at.getName().split("=")[1])))
    return sorted(out)


def read_lock(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The last whole version of a lock folder, or the one asked for; without any, an empty lock."""
    held = [x for x in versions(spark, folder) if version is None or x[1] == version]
    if not held:
        return spark.createDataFrame([], LOCK_SCHEMA)
    schema, number = max(held, key=lambda x: x[1])
    rows = spark.read.schema("id string, json string").json(f"{folder}/schema={schema}/version={number}")
    entry = F.from_json("json", ENTRY)
    return rows.select("id", *[entry[a].alias(b) for a, b in FIELDS.items()])
