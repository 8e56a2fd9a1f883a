"""Which labelled documents a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder `part`; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def training_labels(labels: DataFrame, label: str, parts: int, part: int) -> DataFrame:
    """doc_id and label (0.0 or 1.0) of the rows that are not held out; of repeated ids the larger label."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), parts, part))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("label"))
    )
