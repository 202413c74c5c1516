"""What the training-data operators leave on disk."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from weftgraph.llm import common


def shuffle_files(spark) -> int:
    top = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()
    own = [*glob.glob(f"{top}/blockmgr-*"), *glob.glob(f"{top}/*/blockmgr-*")]
    return sum(name.startswith("shuffle_") for folder in own for _, _, names in os.walk(folder) for name in names)


def test_checkpoints_leave_no_shuffle(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, files = spark.conf.get(setting), shuffle_files(spark)
    counted = spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    made = common.checkpoint(counted.join(counted.toDF("j", "m").hint("merge"), F.col("k") == F.col("j")))
    assert shuffle_files(spark) <= files
    assert spark.conf.get(setting) == before
    assert {r["k"]: (r["n"], r["m"]) for r in made.collect()} == {k: (143, 143) if k < 6 else (142, 142) for k in range(7)}


def test_stored_tables_leave_no_shuffle(spark):
    files = shuffle_files(spark)
    common.stored(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count())
    assert shuffle_files(spark) <= files
