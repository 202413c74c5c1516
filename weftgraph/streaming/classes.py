"""How many requirements reach each node, kept up as shards arrive: the counts behind exclusive nodes and infrastructure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.shards import VERSION, hit_pairs, parse


def stream_whole_shards(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Parsed records of shards as they arrive; a shard is read as one row, so that one of another schema version is left out as a whole."""
    shards = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("shard"), F.split("value", "\n").alias("lines"))
    version = lambda x: F.try_variant_get(F.try_parse_json(x), "$.schemaVersion", "int")
    is_meta = lambda x: F.try_variant_get(F.try_parse_json(x), "$.kind", "string") == "meta"
    other = F.exists("lines", lambda x: F.coalesce(is_meta(x) & (version(x) != VERSION), F.lit(False)))
    return parse(shards.filter(~other).select("shard", F.explode("lines").alias("line")))


def count_requirements(records: DataFrame, symbols: DataFrame, files: DataFrame, generation: str) -> DataFrame:
    """generation, node_id, n_reqs and req_id (the least) over all that has arrived: pairs are remembered, so copies in later shards count once."""
    tests = records.filter("record = 'test'")
    pairs = hit_pairs(tests, symbols, files).select(F.lit(generation).alias("generation"), "req_id", "node_id").dropDuplicates()
    return pairs.groupBy("generation", "node_id").agg(F.count("*").alias("n_reqs"), F.min("req_id").alias("req_id"))


def write_counts(counts: DataFrame, table: str, checkpoint_folder: str) -> StreamingQuery:
    """Write the counts that a batch changed under ``table``/batch=…; a batch that runs again replaces its own folder.  Takes what is there, then stops."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, table: str) -> DataFrame:
    """The last counts of each generation and node."""
    rows = spark.read.parquet(table)
    last = rows.groupBy("generation", "node_id").agg(F.max_by(F.struct("n_reqs", "req_id"), "batch").alias("c"))
    return last.select("generation", "node_id", "c.n_reqs", "c.req_id")


def node_classes(counts: DataFrame, shared_threshold: int = 5) -> DataFrame:
    """``counts`` with class: exclusive for one requirement (req_id is it), infrastructure from the threshold on, else shared (req_id null)."""
    one = F.col("n_reqs") == 1
    kind = F.when(one, "exclusive").when(F.col("n_reqs") >= shared_threshold, "infrastructure").otherwise("shared")
    return counts.select("generation", "node_id", "n_reqs", kind.alias("class"), F.when(one, F.col("req_id")).alias("req_id"))
