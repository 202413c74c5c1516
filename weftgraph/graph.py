"""The typed artifact graph as two DataFrames."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = "id string, kind string, file_path string, label string, content_hash string, metadata map<string,string>"
EDGE_SCHEMA = "source string, target string, kind string, provenances array<string>, target_space string"
LOCK_SCHEMA = (
    "id string, spec_file string, content_hash string, impl array<string>, tests array<string>, exercises array<string>, "
    "depends_on array<struct<id:string,provenances:array<string>>>, last_reconciled string"
)

# Fixed values of the data model.
NODE_KINDS = ["req", "doc", "file", "symbol", "test", "task"]
EDGE_KINDS = ["depends_on", "derives_from", "implements", "verifies", "imports", "contains", "exercises"]
PROVENANCES = ["annotation", "frontmatter", "convention", "code-tag", "task-tag", "inline-link", "ts-import", "structural", "coverage"]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def stored(self, *columns: str) -> Graph:
        """The graph as two tables of the shared folder, for queries that read it more than once; of nodes only ``columns``, if any are named."""
        return Graph(stored(self.nodes.select(*columns) if columns else self.nodes), stored(self.edges))

    def kinds(self, *kinds: str) -> DataFrame:
        return self.nodes.filter(F.col("kind").isin(*kinds))

    def edges_of(self, *kinds: str) -> DataFrame:
        return self.edges.filter(F.col("kind").isin(*kinds))

    def source_kinds(self, edges: DataFrame) -> DataFrame:
        """``edges`` with source_kind, null where the source is no node."""
        kinds = self.nodes.select(F.col("id").alias("source"), F.col("kind").alias("source_kind"))
        return edges.join(kinds, "source", "left")

    def claims(self, kind: str = "implements") -> DataFrame:
        """Edges of ``kind`` that do not come from a task (an unknown source counts)."""
        return self.edges_of(kind).join(self.kinds("task").select(F.col("id").alias("source")), "source", "anti").select("source", *[c for c in self.edges.columns if c != "source"])


def short_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def set_to(spark: SparkSession, setting: str, value: str) -> Iterator[None]:
    before = spark.conf.get(setting)
    spark.conf.set(setting, value)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def as_planned(spark: SparkSession) -> AbstractContextManager[None]:
    """Plans made in it run as they stand: an adaptive plan does not tell how its rows are dealt."""
    return set_to(spark, "spark.sql.adaptive.enabled", "false")


def small_broadcasts(spark: SparkSession) -> AbstractContextManager[None]:
    """Tables run in it are broadcast up to 1 MB only: a file of paths takes twenty times its size and more as a table of the driver, and a build has many."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    return nullcontext() if spark.conf.get(setting).startswith("-1") else set_to(spark, setting, "1m")


def placed(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` that joins find where it lies, by the columns that it was last dealt by."""
    with as_planned(df.sparkSession):
        return checkpoint(df)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again, so that later reads take only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Buckets:
    """A table in the shared folder: ``table`` for joins, which find it where it lies, ``rows`` for all else, and the number of rows ``n``.

    A union of ``table`` with others would be taken for dealt as they are, which it is not.
    """

    table: DataFrame
    rows: DataFrame
    n: int


def bucketed(df: DataFrame, width: int, *by: str) -> Buckets:
    """``df``, dealt by ``by`` over ``width`` partitions, written as Parquet with a bucket for each; unlike a checkpoint it is made once and read column by column."""
    spark, name, seen = df.sparkSession, f"buckets_{uuid.uuid4().hex}", Observation()
    path = f"{shared_folder(spark)}/{name}"
    with as_planned(spark):
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.bucketBy(width, *by).option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    # The name has told where the buckets are; the files stay.
    spark.sql(f"DROP TABLE {name}")
    return Buckets(table, spark.read.schema(df.schema).parquet(path), seen.get["n"])


def dealt(files: DataFrame) -> DataFrame:
    """``files`` by hash of their path over as many partitions as a shuffle has: a table may lie in a few large row groups, and each would be one task."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that is never broadcast: rows that an array or a checkpoint brings forth are estimated far too low."""
    return df.hint("merge")


class Levels:
    """What the rounds of a loop have found: a Parquet folder a round, read one by one or as one table.

    Once ``most`` folders wait, the later ones become one, up to the first that holds
    more than half of all rows: a row is written again a logarithmic number of times.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, most: int = 8):
        self.spark, self.schema, self.most = spark, schema, most
        self.folder, self.rounds = f"{shared_folder(spark)}/levels-{uuid.uuid4().hex}", 0
        self.parts: list[tuple[str, int]] = []

    def add(self, df: DataFrame) -> int:
        """Write one more round; the number of its rows is counted as they are written."""
        seen, path = Observation(), f"{self.folder}/{self.rounds}"
        df.select(self.schema.names).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.rounds += 1
        rows = seen.get["n"]
        self.parts.append((path, rows))
        if len(self.parts) > self.most:
            self.merge()
        return rows

    def merge(self) -> None:
        """Make one folder of the later rounds."""
        total = sum(n for _, n in self.parts)
        keep = 1 if 2 * self.parts[0][1] > total else 0
        late, path = self.parts[keep:], f"{self.folder}/to-{self.rounds}"
        self.read(late).write.parquet(path)
        self.parts = [*self.parts[:keep], (path, sum(n for _, n in late))]

    def read(self, parts: list[tuple[str, int]]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[path for path, _ in parts])

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{self.rounds - 1}")

    def all(self) -> DataFrame:
        return self.read(self.parts)


def owner_path(node_id: Column) -> Column:
    """Path that owns a file or symbol id (the last # splits a symbol), else null."""
    file = F.regexp_extract(node_id, r"^file:(.*)$", 1)
    symbol = F.regexp_extract(node_id, r"^symbol:(.*)#[^#]*$", 1)
    return F.when(node_id.startswith("file:"), file).when(node_id.startswith("symbol:") & (symbol != ""), symbol)
