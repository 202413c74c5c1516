"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only white space that the operators' contracts name.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def small_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Bound what one Arrow batch holds, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``.

    A session that has none gets one in the temporary folder if it is local;
    on a cluster that would be one machine's disk, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query ends, not once the driver's collector finds them unused."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder; the shuffles behind a checkpoint go as soon as it is written."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew: a plan keeps the setting that it was made under


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read again: for what is too large for a checkpoint's plain rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(taken: Iterable[str], name: str) -> str:
    """``name`` with underscores before it until no column of ``taken`` is called so."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int = 256) -> DataFrame:
    """Gapless numbers from 0 within each group, without a task that holds a whole group.

    Rows are spread over ``buckets`` hash buckets of ``order`` within each group
    and numbered there; the bucket's offset is a sum over at most ``buckets``
    counts.  ``df`` is evaluated twice, so pass something cheap or checkpointed.
    Rows that agree in all of ``order`` are interchangeable.
    """
    keyed = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    names = [f"__g{i}" for i in range(len(group))]
    counts = (
        keyed.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col("__b").alias("__ob"))
        .agg(F.count("*").alias("__n"))
        .groupBy(*names)
        .agg(F.collect_list(F.struct("__ob", "__n")).alias("__all"))
        .select(*names, "__all", F.explode("__all").alias("__own"))
        .select(
            *names,
            F.col("__own.__ob").alias("__ob"),
            F.aggregate(
                F.filter("__all", lambda x: x["__ob"] < F.col("__own.__ob")), F.lit(0).cast("long"), lambda acc, x: acc + x["__n"]
            ).alias("__offset"),
        )
    )
    on = F.col("__b") == F.col("__ob")
    for g, n in zip(group, names, strict=True):
        on = on & F.col(g).eqNullSafe(F.col(n))
    inner = Window.partitionBy(*group, "__b").orderBy(*order)
    return (
        keyed.withColumn("__rn", F.row_number().over(inner))
        .join(counts, on, "left")
        .withColumn(out, F.col("__offset") + F.col("__rn") - 1)
        .drop("__b", "__rn", "__ob", "__offset", *names)
    )


def widened(schema: T.StructType, **more: str) -> T.StructType:
    """A schema with more columns behind; ``schema`` itself stays as it is."""
    return T.StructType([*schema.fields, *[T.StructField(name, T._parse_datatype_string(kind)) for name, kind in more.items()]])


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def next_power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()

