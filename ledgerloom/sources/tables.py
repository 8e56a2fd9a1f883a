"""Stored tables: reading with a fixed schema, writing, and where checkpoints go."""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] = ()) -> None:
    """Write parquet. Overwriting a partitioned table replaces only the partitions present in `df`."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a table; a table nobody has written yet is empty."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(location):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def shared_folder(spark: SparkSession, fallback: str | Path) -> str:
    """The folder the cluster names for checkpoints. The fallback serves a local session only: on a cluster
    a folder of one machine would be missing on the others."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return str(fallback)


def keep(df: DataFrame, name: str, fallback: str | Path) -> DataFrame:
    """Write an intermediate result that several jobs read, and go on from the written table.

    The table outlives lost executors, cuts the lineage and gives the planner real sizes. Every call writes a
    table of its own, so a result of an earlier run stays readable.
    """
    path = f"{shared_folder(df.sparkSession, fallback)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, name: str, fallback: str | Path, keys: list[str], buckets: int) -> DataFrame:
    """A written table in hash buckets of its keys, sorted by key and day within them.

    Aggregations, windows and joins whose keys begin with these need no exchange of its rows: all rows of an account lie in one
    bucket. A bucket is one task, so it serves where no account alone is too large for one. Joins on more columns than the
    keys go without an exchange if spark.sql.requireAllClusterKeysForCoPartition is false.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession, fallback)}/{table}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, "booking_date").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
