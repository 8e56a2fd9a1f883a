"""Bank feed as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schema import FEED


def _located(raw: DataFrame) -> DataFrame:
    """Each file is one batch."""
    return raw.select(
        "*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_path").alias("batch_id"),
        F.col("_metadata.file_block_start").alias("block_start"))


def numbered(located: DataFrame) -> DataFrame:
    """Add `batch_ord`, the order of the rows inside their file.

    Splits of a file keep their byte offset, and full splits are read alone by a task, so offset plus
    row count orders the rows of a file and never repeats.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return located.withColumn("batch_ord", F.col("block_start") + row).drop("block_start")


def read_feed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return numbered(_located(spark.read.schema(FEED).json(path)))


def stream_feed(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Feed files as a stream. Row numbers are added per micro-batch, where partitions still follow splits."""
    return _located(spark.readStream.schema(FEED).option("maxFilesPerTrigger", max_files).json(path))
