"""Sharding by extendible hashing.

Documents are addressed by the bits of a hash. A shard is a prefix of those bits; a shard over its byte
limit is split on one more bit, all others stay as they are. The sizes of ROUND_BITS further bits are
counted in one aggregation over the documents of shards that are still too large, so there are about
log2(documents) / ROUND_BITS rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import row_of, saved, work_folder

HASH_BITS = 60
ROUND_BITS = 12
SHARD_BYTES = 1 << 20
KEYS = ["p1", "p2"]


def content_bits(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of the id and the text, so rows that share an id can still be parted."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(depth: Column | int) -> list[Column]:
    """The first `depth` of the 120 address bits, as the taken bits of both halves."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    first = F.call_function("shiftrightunsigned", F.col("h1"), HASH_BITS - F.least(depth, F.lit(HASH_BITS)))
    second = F.call_function("shiftrightunsigned", F.col("h2"), HASH_BITS - F.greatest(depth - HASH_BITS, F.lit(0)))
    return [first.alias("p1"), second.alias("p2")]


def _cut(depth: Column, known: int) -> list[Column]:
    """The first `depth` bits of a prefix of `known` bits."""
    gone_second = F.least(F.lit(max(known - HASH_BITS, 0)), F.lit(known) - depth)
    return [F.call_function("shiftrightunsigned", F.col("p1"), F.lit(known) - depth - gone_second).alias("q1"),
            F.call_function("shiftrightunsigned", F.col("p2"), gone_second).alias("q2")]


def _round(alive: DataFrame, depth: int, limit: int) -> DataFrame:
    """For every prefix ROUND_BITS deeper: depth, bytes and rows of its shard; nulls where it is still too large."""
    deep = depth + ROUND_BITS
    leaves = saved(alive.select(*_prefix(deep), "n_bytes", "n_docs").groupBy(*KEYS)
                   .agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_docs").alias("n_docs")), "prefixes")
    depths = F.sequence(F.lit(0 if depth == 0 else depth + 1), F.lit(deep))
    laid = leaves.select("*", F.explode(depths).alias("depth")).select("*", *_cut(F.col("depth"), deep))
    sizes = laid.groupBy("depth", "q1", "q2").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"))
    fitting = sizes.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    found = (
        laid.join(fitting, ["depth", "q1", "q2"]).groupBy(*KEYS)
        .agg(F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("shard"))
    )
    return saved(leaves.select(*KEYS).join(found, KEYS, "left"), "directory")


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, place: str | None = None) -> DataFrame:
    """row_no, doc_id, shard (its bits as a string), depth, shard_bytes and shard_docs of every row.

    Bytes are those of the UTF-8 text; null counts as empty. Every shard keeps to the limit unless it is a single
    document. Rows equal in id and text share their first 60 bits and are parted by 60 more, drawn
    from their place in the table: the column named by `place`, or else their row number. An empty table has no shards.
    """
    rows = saved(docs.select(
        (F.col(place) if place else F.monotonically_increasing_id()).alias("row_no"), "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        content_bits(F.col("doc_id"), F.col("text")).alias("h1"), F.lit(1).cast("long").alias("n_docs")), "addresses")
    rows = rows.withColumn("h2", F.shiftrightunsigned(F.xxhash64("row_no"), 64 - HASH_BITS))
    alive, depth, done = rows, 0, []
    while depth + ROUND_BITS <= 2 * HASH_BITS:
        directory = _round(alive, depth, limit)
        depth += ROUND_BITS
        placed = alive.select("*", *_prefix(depth)).join(directory, KEYS).drop(*KEYS)
        done.append(placed.filter("shard IS NOT NULL"))
        if directory.filter("shard IS NULL").isEmpty():
            break
        alive = saved(placed.filter("shard IS NULL").drop("shard"), "oversized")
    bits = F.concat(*(F.lpad(F.bin(h), HASH_BITS, "0") for h in ("h1", "h2")))
    return reduce(DataFrame.unionByName, done).select(
        "row_no", "doc_id", F.substring(bits, F.lit(1), F.col("shard.depth")).alias("shard"),
        F.col("shard.depth").cast("long").alias("depth"), F.col("shard.shard_bytes").alias("shard_bytes"),
        F.col("shard.shard_docs").alias("shard_docs"))


def _directories(alive: DataFrame, first: int, last: int, limit: int) -> tuple[list[tuple[int, DataFrame]], DataFrame | None]:
    """The directory of every round between two depths, and the addresses whose shard is too large even then."""
    found, depth = [], first
    while depth + ROUND_BITS <= last:
        directory = _round(alive, depth, limit)
        depth += ROUND_BITS
        found.append((depth, directory.withColumnRenamed("shard", f"shard{depth}")))
        oversized = directory.filter("shard IS NULL")
        if oversized.isEmpty():
            return found, None
        alive = saved(alive.select("*", *_prefix(depth)).join(oversized.select(*KEYS), KEYS).drop(*KEYS), "oversized")
    return found, alive


def _placed(rows: DataFrame, directories: list[tuple[int, DataFrame]]) -> DataFrame:
    """Add `shard`, the bits of the shard of every row. A directory has a row for a prefix and is joined by Spark's size check."""
    for depth, directory in directories:
        rows = rows.select("*", *_prefix(depth)).join(directory, KEYS, "left").drop(*KEYS)
    depth = F.coalesce(*[F.col(f"shard{d}.depth") for d, _ in directories]) if directories else F.lit(0)
    bits = F.concat(*(F.lpad(F.bin(h), HASH_BITS, "0") for h in ("h1", "h2")))
    return rows.withColumn("shard", F.substring(bits, F.lit(1), depth))


def write_shards(docs: DataFrame, folder: str, limit: int = SHARD_BYTES) -> None:
    """Write the documents as one folder of Parquet files per shard. Extra columns are kept, but for one named shard.

    Shards are those of `assign_shards`, whatever the partitions of the table. Addresses are counted without the texts; the
    texts are then read once more and shuffled once, by shard. Only rows whose equals in id and text fill
    more than a shard are numbered, for which they are written in between.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    kept = docs.select(row_of(docs.drop("shard")).alias("doc"), size, content_bits(F.col("doc_id"), F.col("text")).alias("h1"),
                       F.lit(0).cast("long").alias("h2"))
    addresses = saved(kept.groupBy("h1", "h2").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs")), "addresses")
    directories, repeated = _directories(addresses, 0, HASH_BITS, limit)
    rows = _placed(kept, directories).filter("shard IS NOT NULL")
    if repeated is not None:
        equal = saved(kept.join(repeated.select("h1"), "h1", "left_semi").withColumn("row_no", F.monotonically_increasing_id()), "repeated") \
            .withColumn("h2", F.shiftrightunsigned(F.xxhash64("row_no"), 64 - HASH_BITS))
        more, _ = _directories(equal.select("h1", "h2", "n_bytes", F.lit(1).cast("long").alias("n_docs")), HASH_BITS, 2 * HASH_BITS, limit)
        rows = rows.select("doc", "shard").unionByName(_placed(equal, more).select("doc", "shard"))
    rows.select("doc.*", F.concat(F.lit("s"), "shard").alias("shard")).repartition("shard").write.partitionBy("shard").parquet(folder)


def written_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Write the shards to a new work folder; doc_id, shard, depth, shard_bytes and shard_docs as the files have them."""
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession, "shards")
    write_shards(docs.select("doc_id", "text"), folder, limit)
    files = spark.read.schema(docs.select("doc_id", "text").withColumn("shard", F.lit("")).schema).parquet(folder) \
        .withColumn("shard", F.substring("shard", 2, 2 * HASH_BITS))
    sizes = files.groupBy("shard").agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return files.select("doc_id", "shard").join(sizes, "shard").select(
        "doc_id", "shard", F.length("shard").cast("long").alias("depth"), "shard_bytes", "shard_docs")


ORACLE = f"""
WITH rows AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
laid AS (SELECT doc_id, n_bytes, h, depth, h >> ({HASH_BITS} - depth) AS prefix FROM rows, generate_series(0, 30) g(depth)),
sized AS (SELECT *, sum(n_bytes) OVER s AS shard_bytes, count(*) OVER s AS shard_docs FROM laid
  WINDOW s AS (PARTITION BY depth, prefix)),
best AS (SELECT * FROM sized WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1)
SELECT doc_id, CAST(depth AS BIGINT) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs,
 right(repeat('0', 64) || bin(prefix), depth) AS shard FROM best"""
