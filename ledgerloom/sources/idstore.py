"""Stored ids in slots of their hash, so that a batch is held against a few slots and not against all ids.

The slots that a batch asks for are a bounded list of numbers, which prunes partitions of the store before anything is
read. Inside a slot ids are sorted and have a bloom filter, which Parquet uses for lookups of single ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.sources.tables import read_table

SLOTS = 1024


def slot_of(ident: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(slots)).cast("int")


def write_ids(rows: DataFrame, path: str, stream_batch: int, slots: int = SLOTS) -> None:
    """Add the ids of a batch. Adding them again does no harm."""
    ids = rows.select("id", F.lit(stream_batch).cast("long").alias("stream_batch"), slot_of(F.col("id"), slots).alias("slot"))
    ids.repartition("slot").sortWithinPartitions("slot", "id").write.mode("append").option(
        "parquet.bloom.filter.enabled#id", "true").partitionBy("slot").parquet(path)


def stored_near(rows: DataFrame, path: str, slots: int = SLOTS) -> DataFrame:
    """The stored ids (id, stream_batch) in the slots that `rows` ask for. At most `slots` numbers reach the driver."""
    stored = read_table(rows.sparkSession, path, schema.STORED_IDS)
    asked = [r.slot for r in rows.select(slot_of(F.col("id"), slots).alias("slot")).distinct().collect()]
    return stored.filter(F.col("slot").isin(asked)).select("id", "stream_batch")


def unstored(rows: DataFrame, path: str, ledger: DataFrame, stream_batch: int, slots: int = SLOTS) -> DataFrame:
    """Rows whose id is new, each id once as in the rows.

    Ids are written before the rows of their batch. Where ids of this very batch are found, it runs again after a loss and it
    is not known how far it came: only then are the rows held against the ledger itself.
    """
    near = stored_near(rows, path, slots)
    new = rows.join(near.filter(F.col("stream_batch") != stream_batch), "id", "left_anti")
    again = near.filter(F.col("stream_batch") == stream_batch)
    if again.isEmpty():
        return new.select(*rows.columns)
    return new.join(ledger.select("id").join(rows.select("id"), "id", "left_semi").distinct(), "id", "left_anti").select(*rows.columns)
