"""A table as files in a total order: file by file and line by line, the rows are sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_ordered(df: DataFrame, keys: list[str], folder: str) -> None:
    """Write ``df`` as Parquet files whose names in order, read one after the other, give the rows sorted by ``keys``.

    Rows are dealt by ranges of the keys, from a sample that Spark takes, and each
    range is sorted in its own task, so no task sees all rows; nulls come first.
    """
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(folder)


def read_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """The rows with place, their number from 0 over all files: the rows of earlier files, which are counted, and those before them in their own."""
    rows = spark.read.parquet(folder).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = rows.groupBy("__file").agg(F.count("*").alias("n"))
    before = counts.select(F.col("__file").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a file
    return rows.join(before, F.col("__file") == F.col("of")).withColumn("place", F.col("before") + F.col("__row")).drop("__file", "__row", "of", "before")
