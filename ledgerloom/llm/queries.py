"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import (
    bpe, contentsort, decontam, linerun, passages, phrases, quality, secretscan, sharding, simhash, tokenfiles, toxicity, turnrepair)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf, "documents"), bpe.default_path())


def op3_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.written_shards(_table(spark, sf, "documents"))


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return linerun.line_digests(_table(spark, sf, "documents"))


def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return contentsort.exact_duplicates(_table(spark, sf, "documents"))


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokenfiles.token_digests(_table(spark, sf, "documents"), bpe.default_path())


def op10_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf, "documents"))


def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf, "documents"))


def op12_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secretscan.secret_digests(_table(spark, sf, "documents"))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return turnrepair.repair_digests(_table(spark, sf, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_bpe, op3_sharding, op4_simhash, op5_quality, op6_line_dedup, op7_exact_dedup,
    op8_toxicity, op9_token_files, op10_passages, op11_phrases, op12_secrets, op13_conversation_repair)}
ORACLES: dict[str, str] = {
    "op3_sharding": sharding.ORACLE,
    "op6_line_dedup": linerun.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op7_exact_dedup": """
WITH rows AS (SELECT doc_id, coalesce(length(text), 0) AS n_chars,
  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
ranked AS (SELECT *, row_number() OVER same AS place, first_value(doc_id) OVER same AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size FROM rows
  WINDOW same AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked""",
}
