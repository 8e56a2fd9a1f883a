"""What the operators of this subpackage share: intermediate tables, row numbers, Arrow chunks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 21
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = str(Path(__file__).resolve().parents[2])


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="ledgerloom-")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder named in spark.checkpoint.dir.

    Where none is named, a local session gets a temporary folder; a cluster session fails, because a
    folder of one machine would be missing on the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith(("local[", "local")) \
                or spark.conf.get("spark.master", "local").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when their query ends, not when the driver next collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several jobs read and go on from the written table.

    It outlives lost executors, cuts the lineage, and fixes row numbers and sampled choices. Nothing reads the shuffle
    files of the write once it is done, so they go with it.
    """
    path = work_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder that `work_folder` has named, with all that is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `saved` has written, for when whatever reads them has been written as well."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            removed(table.sparkSession, folder)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that executors share, and the folder in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def numbered(docs: DataFrame, columns: list[str], row: str = "row_no") -> DataFrame:
    """The named columns and a number that tells rows apart even when ids repeat or are null.

    The number is fixed once the result, or something computed from it, has been written.
    """
    return docs.select(F.monotonically_increasing_id().alias(row), *[F.col(c) for c in columns])


def row_of(docs: DataFrame) -> Column:
    """All columns of a table as one struct, whatever their names."""
    return F.struct(*[F.col("`" + name.replace("`", "``") + "`") for name in docs.columns])


def in_tasks(function: Callable, *args) -> Callable:
    """A function of a batch iterator that imports `function` where it runs and calls it with `args`.

    Workers find the package even when only the driver's path has it, as long as its folder is there.
    """
    module, name, root = function.__module__, function.__qualname__, ROOT

    def run(*batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        return getattr(importlib.import_module(module), name)(*args, *batches)

    return run


def chunked(batches: Iterator[pa.RecordBatch], text: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of about `chunk_bytes` of `text` each, at least one row.

    The memory of a task so follows the longest text and not the number of rows Spark packs into a batch.
    """
    for batch in batches:
        yield from slices(batch, text, chunk_bytes)


def slices(batch: pa.RecordBatch, text: str, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + chunk_bytes, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (null is empty) and the row offsets into them, from 0."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, bounds, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(bounds, dtype=kind)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
