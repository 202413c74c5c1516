"""What was read out of a file, kept by path and content, so that a second build reads changed files only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..graph import stored


@dataclass(frozen=True)
class Fragments:
    """A folder of tables, each with a generation of rows a build; a generation shows up when its job commits."""

    folder: str

    def table(self, spark: SparkSession, name: str) -> DataFrame | None:
        """All kept rows of a table with path, key and generation; null if there are none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "generation=*/_SUCCESS")):
            return None
        return spark.read.parquet(f"{self.folder}/{name}")

    def read(self, files: DataFrame, name: str, parse: Callable[[DataFrame], DataFrame], options: str = "") -> tuple[DataFrame, int]:
        """The rows of ``parse(files)`` for ``files(path, text)``, and how many files had to be parsed.

        A fragment is known by its path and the digest of text and ``options``.
        Known ones are read from the table; the rest is found by an anti-join,
        parsed, and kept as one more generation.  ``parse`` must give at least one
        row for each file with text; null and empty texts have no fragment.
        """
        spark = files.sparkSession
        keyed = files.filter("text <> ''").select("path", "text", F.sha2(F.concat_ws("\0", F.lit(options), "text"), 256).alias("key")).dropDuplicates(["path"])
        keys = stored(keyed.select("path", "key"))
        old = self.table(spark, name)
        number, fresh = 0, keyed
        if old is not None:
            number = (old.agg(F.max("generation")).first()[0] or 0) + 1
            # Builds that ran at once may have kept a fragment twice: one generation of it counts.
            known = stored(old.select("path", "key", "generation").join(keys, ["path", "key"], "semi").groupBy("path", "key").agg(F.min("generation").alias("generation")))
            fresh = keyed.join(known, ["path", "key"], "anti")
        seen, folder = Observation(), f"{self.folder}/{name}/generation={number}"
        rows = parse(fresh.observe(seen, F.count(F.lit(1)).alias("n")).select("path", "text"))
        rows.join(keys, "path").write.option("compression", "zstd").parquet(folder)
        read = spark.read.parquet(folder).select(rows.columns)
        if old is not None:
            read = stored(old.join(known, ["path", "key", "generation"], "semi").select(rows.columns).unionByName(read))
        return read, seen.get["n"]

    def prune(self, files: DataFrame, name: str, target: str) -> None:
        """Write the fragments of the paths in ``files`` alone as a table in another folder, ``target``."""
        held = self.table(files.sparkSession, name)
        if held is not None:
            last = held.groupBy("path").agg(F.max("generation").alias("generation"))
            kept = held.join(last, ["path", "generation"], "semi").join(files.select("path").distinct(), "path", "semi")
            kept.drop("generation").write.option("compression", "zstd").parquet(f"{target}/{name}/generation=0")
