"""Exact duplicates by sorting content.

Normalised texts are dealt by ranges whose splitters Spark samples, sorted inside each range (spilling to
disk as needed), and compared in full with their neighbour. The order is: first bytes, digest, most code
points, smallest doc_id; so equal texts are adjacent and the one that stays comes first. The ranges use
the same order without the full text, so a group of any size is cut into as many ranges as it needs,
and the runs on both sides of a border are joined by comparing their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import chunked, in_tasks, saved

HEAD = 64
# The white space that does not count.
BLANKS = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
RUNS = "part int, run long, doc_id long, n_chars long, digest binary, border string"
RUNS_ARROW = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
                        ("digest", pa.binary()), ("border", pa.string())])


def normalised(text: Column) -> Column:
    """The text without blanks, tabs and line ends; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal texts of one sorted range.

    `border` carries the text of the first row and of the last run's first row, for the neighbouring ranges.
    """
    part = TaskContext.get().partitionId()
    run, last, digest = -1, None, b""
    held: dict | None = None

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, RUNS_ARROW)

    for piece in chunked(batches, "norm"):
        rows = []
        for doc_id, n_chars, text in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "n_chars", "norm"))):
            if last is None or text != last:
                run, last = run + 1, text
                digest = hashlib.sha256(text.encode()).digest()
                if held is not None:
                    rows.append(held)
                held = {"part": part, "run": run, "doc_id": doc_id, "n_chars": n_chars, "digest": digest,
                        "border": text if run == 0 else None}
            else:
                rows.append({"part": part, "run": run, "doc_id": doc_id, "n_chars": n_chars, "digest": digest, "border": None})
        if rows:
            yield batch_of(rows)
    if held is not None:
        yield batch_of([held | {"border": last}])


def sorted_runs(docs: DataFrame) -> DataFrame:
    """Every row with its range and run: part, run, doc_id, n_chars, digest (SHA-256), border.

    The first row of a run is the one that stays, but for runs that continue one of an earlier range.
    """
    norm = normalised(F.col("text"))
    keyed = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), norm.alias("norm"))
    keyed = keyed.withColumns({"head": F.substring("norm", 1, HEAD), "mark": F.md5("norm")})
    rank = [F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last()]
    spread = keyed.withColumn("row_no", F.monotonically_increasing_id())
    dealt = (
        spread.repartitionByRange("head", "mark", *rank, "row_no")
        .sortWithinPartitions("head", "mark", "norm", *rank).select("doc_id", "n_chars", "norm")
    )
    return saved(dealt.mapInArrow(in_tasks(_compare), RUNS), "runs")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Of texts that are equal without white space, the row with the most code points stays, then the one with the smallest
    doc_id (a row without an id after all others). Null counts as empty, and all empty texts are one group. Of rows
    that repeat an id and a text exactly, one stays. doc_id is a long; other columns are not read, whatever their names. A text
    is sorted and compared whole, whatever its length.
    """
    runs = sorted_runs(docs)
    first = F.row_number().over(Window.partitionBy("part", "run").orderBy(F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last()))
    placed = runs.drop("border").withColumn("place", first)
    sizes = saved(placed.groupBy("part", "run").agg(
        F.count("*").alias("size"), F.first(F.when(F.col("place") == 1, F.struct("doc_id")), ignorenulls=True).alias("best")),
        "groups")
    # One row of three numbers per range comes together in one task; the texts at the borders meet two by two.
    borders = runs.filter("border is not null")
    ends = borders.groupBy("part").agg(F.min_by("border", "run").alias("head"), F.max_by("border", "run").alias("tail"))
    order = Window.orderBy("part")
    ranges = saved(borders.groupBy("part").agg(F.max("run").alias("last")).select(
        "part", F.lag("part").over(order).alias("earlier"), F.lag("last").over(order).alias("run")), "ranges")
    met = ranges.join(ends.select("part", "head"), "part").join(ends.select(F.col("part").alias("earlier"), "tail"), "earlier") \
        .select("part", (F.col("head") == F.col("tail")).alias("joined"))
    starts = ranges.join(met, "part", "left").select(
        "part", "joined", (F.col("run") == 0).alias("whole"), F.struct(F.col("earlier").alias("part"), "run").alias("before"))
    # A range that is one single run passes on the origin of its own start.
    own = F.struct("part", F.lit(0).cast("long").alias("run"))
    origin = F.when(~F.coalesce("joined", F.lit(False)), own).when(~F.col("whole"), F.col("before"))
    chains = starts.select("part", origin.alias("origin"))
    heads = chains.select("part", F.lit(0).cast("long").alias("run"),
                          F.last("origin", ignorenulls=True).over(order).alias("origin"))
    rooted = sizes.join(heads, ["part", "run"], "left").withColumn(
        "origin", F.coalesce("origin", F.struct("part", "run")))
    groups = rooted.groupBy("origin").agg(F.sum("size").alias("group_size"),
                                          F.min_by("best", F.struct("part", "run")).alias("keep"))
    named = rooted.join(groups, "origin").select("part", "run", "group_size", F.col("keep.doc_id").alias("keep_id"),
                                                 (F.col("origin") == F.struct("part", "run")).alias("leads"))
    return placed.join(named, ["part", "run"]).select(
        "doc_id", "keep_id", "group_size", ((F.col("place") == 1) & F.col("leads")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
