"""Links between the members of shared buckets without emitting their pairs.

Members of a bucket are compared in memory, and only a spanning forest of the links found is returned.
A bucket with more members than a block is split: every two of its blocks meet in a group of their own,
so no task holds more than two blocks and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import in_tasks

BLOCK = 2048
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (first member of the component, member) of a symmetric boolean matrix."""
    n = len(linked)
    root = np.full(n, -1)
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start] = start
        front = np.array([start])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
            root[front] = start
    members = np.flatnonzero(root != np.arange(n))
    return root[members], members


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        last = tuple(c[-1] for c in columns)
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for place, (start, stop) in enumerate(zip(bounds, bounds[1:])):
            if place > 0 or change[0]:
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            if stop > start:
                held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _links(module: str, name: str, args: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import importlib

    compare: Callable[..., np.ndarray] = getattr(importlib.import_module(module), name)
    left, right, count = [], [], 0
    for group in groups_of(batches, ["key", "one", "two"]):
        if group.num_rows < 2:
            continue
        group = group.combine_chunks()
        a, b = forest(compare(group, *args))
        ids = group.column("member").to_numpy()
        left.append(ids[a])
        right.append(ids[b])
        count += len(a)
        if count >= 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=LINKS)
            left, right, count = [], [], 0
    if count:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=LINKS)


def bucket_links(members: DataFrame, compare: Callable[..., np.ndarray], args: tuple = (), block: int = BLOCK) -> DataFrame:
    """Links (a, b) of a spanning forest of every bucket.

    `members` has key, n (members of the bucket), member (a long) and whatever `compare` needs; `compare`
    gets the rows of a group as an Arrow table, and `args`, and returns the symmetric matrix of links.
    """
    blocks = F.ceil(F.col("n") / block)
    mine = F.pmod(F.xxhash64("member"), F.col("blocks"))
    meetings = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(
        F.least(other, F.col("mine")).alias("one"), F.greatest(other, F.col("mine")).alias("two")))
    dealt = (
        members.withColumn("blocks", blocks).withColumn("mine", mine)
        .select("*", F.inline(meetings)).drop("n", "blocks", "mine")
        .repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    )
    return dealt.mapInArrow(
        in_tasks(_links, compare.__module__, compare.__name__, args), "a long, b long")
