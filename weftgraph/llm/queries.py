"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embeddings, exact_dedup, filter_audit, langid, line_dedup, lm_score, mixing, packing, sharding, simhash, token_counts, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), documents=10, least=1)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams, learned from the documents that op2 learns from, so that what only the others hold backs off."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    return lm_score.score_documents(table(spark, sf_dir, "documents"), order=2, least=1, learn=fold != 1)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_language_id,
        op3_packing,
        op4_exact_dedup,
        op5_line_dedup,
        op6_token_counts,
        op7_mixing,
        op8_simhash,
        op9_embedding_dedup,
        op10_lm_score,
        op11_filter_audit,
        op12_vector_codes,
        op13_byte_bpe,
    )
}

WHITE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: DuckDB SQL where SQL can express the contract.  The others need CRC-32, a
#: tokenizer, XXH64 or random rounding and are tested against brute force.
ORACLE: dict[str, str] = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d
    """,
    "op5_line_dedup": f"""
        WITH split AS (
          SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
        ), lines AS (
          SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM split
        ), keyed AS (
          SELECT doc_id, i, line,
                 translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM lines
        ), often AS (
          SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT keyed.doc_id AS doc_id, count(*) AS n_lines, count(often.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN often ON keyed.k = often.k GROUP BY keyed.doc_id
    """,
    "op11_filter_audit": filter_audit.oracle_sql(),
    "op12_vector_codes": vector_codes.oracle_sql(),
}
