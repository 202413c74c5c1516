"""Training-corpus pipeline: five stages, each one of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import langid, line_dedup, mixing, near_dedup, packing
from weftgraph.llm.common import shared_folder, shuffles_removed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null, empty and letterless texts.

    Ties go to the first language by code point; repeated rows fare alike; a null
    doc_id stays null; an empty table, or one without labels, gives an empty one.
    """
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten or more documents stay in the first one only.

    The first is the document with the smallest doc_id, null last; rows that share
    it each keep the line.  Null texts come back empty; columns stay as they are,
    whatever they are called; an empty table gives an empty one.
    """
    return line_dedup.dedup_lines(docs, documents=10, keep_first=True, counts=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share 0.8 or more of their five-word shingles with one of smaller doc_id go.

    Null, empty and blank texts are copies of each other.  Rows that repeat a
    doc_id stay once; rows without a doc_id all stay; an empty table gives an
    empty one.
    """
    return near_dedup.keep_unlike(docs, words=5, least=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as often as their source's target asks for, which may be never.

    Documents without words stay once.  Rows that agree in doc_id, source and size
    repeat alike; null sources are one source; an empty table gives an empty one.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence, with their token ids.

    Null and empty texts have the end id only; repeated rows are packed each;
    pieces that agree in doc_id and ids are interchangeable; a null doc_id stays
    null; an empty table gives an empty one.
    """
    return packing.pack(docs, with_ids=True)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: Rounding draws, XXH64 and the tokenizer are not SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        with shuffles_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
