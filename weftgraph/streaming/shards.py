"""A folder of trace shards as a stream into tables of one generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shards import parse


def stream_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed records of shards as they arrive."""
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("shard"), F.col("value").alias("line"))
    return parse(lines)


def write_generation(records: DataFrame, table: str, generation: str, checkpoint_folder: str) -> StreamingQuery:
    """Append records under ``table``/generation=…/batch=…; a batch that runs again replaces its own folder.

    Records are sets within a generation, so readers apply ``normalise`` and
    need no state here.  Takes what is there, then stops.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/generation={generation}/batch={number}")

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).start()


def read_generation(spark: SparkSession, table: str, generation: str) -> DataFrame:
    return spark.read.parquet(f"{table}/generation={generation}").drop("batch")
