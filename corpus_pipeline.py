"""The document pipeline: stages in order, each over all rows its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontam, linerun, simhash, toxicity
from ledgerloom.llm.shared import shuffles_removed, work_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject (operator 8)."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without runs of lines that occur earlier (operator 6); n_chars follows the text."""
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return linerun.without_repeats(docs).withColumn("n_chars", n_chars).select(
        *[f"`{name}`" for name in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 4)."""
    return simhash.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not give away benchmark items (operator 1)."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and their decoded text, as digests (operator 2)."""
    return bpe.round_trip(docs, bpe.default_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("lines", cut_lines), ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated), ("tokens", tokens)]

#: The classifier and the fingerprints cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_folder(spark, f"pipeline-{name}")
        result = stage(spark, docs, sf_dir)
        with shuffles_removed(spark):
            result.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
