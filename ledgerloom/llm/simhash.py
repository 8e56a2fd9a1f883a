"""SimHash near-duplicates by the pigeonring filter.

A fingerprint of 64 bits is a ring of eight segments. If two fingerprints differ in at most three bits,
some segment starts a chain in which the first l segments differ in at most floor(3 l / 8) bits, for every l: two
equal segments, then at most one bit in the next three, two within seven, three in all. Two of those three
next segments are therefore equal as well, so each fingerprint is looked up under 8 x 3 keys of 32 equal
bits. Candidates whose chain exceeds its budget anywhere are dropped before the full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.buckets import bucket_links
from ledgerloom.llm.components import components
from ledgerloom.llm.shared import chunked, in_tasks, numbered, row_of, saved, text_buffer

SHINGLE_WORDS = 3
SEED = 42
BITS_APART = 3
SEGMENTS = 8
WIDTH = 64 // SEGMENTS
BUDGETS = [BITS_APART * length // SEGMENTS for length in range(1, SEGMENTS + 1)]
COUNTED_AT_ONCE = 1 << 16


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of the word shingles of a UTF-8 text; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS))))
    hashes = np.array(list(map(xxh64_intdigest, shingles, repeat(SEED))), "<u8")
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), COUNTED_AT_ONCE):
        part = hashes[start:start + COUNTED_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in chunked(batches, "text"):
        data, offsets = text_buffer(piece.column("text"))
        raw, bounds = data.tobytes(), offsets.tolist()
        prints = np.array([fingerprint(raw[a:b]) for a, b in zip(bounds, bounds[1:])], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([piece.column("row_no"), piece.column("doc_id"), pa.array(prints)],
                                         ["row_no", "doc_id", "fp"])


def fingerprints(rows: DataFrame) -> DataFrame:
    """row_no, doc_id and fp (the fingerprint's bits as a long) of rows with a text; null counts as empty."""
    return rows.select("row_no", "doc_id", "text").mapInArrow(in_tasks(_fingerprints), "row_no long, doc_id long, fp long")


def _segment(fp: Column, place: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (place % SEGMENTS)).bitwiseAND((1 << WIDTH) - 1)


def chain_keys(fp: Column) -> Column:
    """The 24 keys of a fingerprint: where the chain starts, which later segment may differ, 32 equal bits."""
    keys = []
    for start in range(SEGMENTS):
        for free in range(3):
            equal = [start, start + 1, *(start + 2 + i for i in range(3) if i != free)]
            key = F.lit(3 * start + free).cast("long")
            for place in equal:
                key = F.shiftleft(key, WIDTH).bitwiseOR(_segment(fp, place))
            keys.append(key)
    return F.array(*keys)


def chain_within_budget(a: Column, b: Column, key: Column) -> Column:
    """Whether the chain that starts where the key says keeps all its budgets, the last for the whole ring."""
    apart = a.bitwiseXOR(b)
    start = (F.shiftrightunsigned(key, 32) / 3).cast("int") * WIDTH
    turned = F.call_function("shiftrightunsigned", apart, start).bitwiseOR(
        F.when(start == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", apart, 64 - start)))
    fits = F.lit(True)
    for length, budget in enumerate(BUDGETS, 1):
        mask = (1 << (WIDTH * length)) - 1
        fits = fits & (F.bit_count(turned.bitwiseAND(mask if length < SEGMENTS else -1)) <= budget)
    return fits


def within_budget(group: pa.Table) -> np.ndarray:
    """The same test for all members of one bucket, segment by segment along the ring."""
    values = group.column("member").to_numpy().view(np.uint64)
    start = int(group.column("key")[0].as_py()) >> 32
    shift = np.uint64(start // 3 * WIDTH)
    turned = (values >> shift) | (values << ((np.uint64(64) - shift) & np.uint64(63))) if shift else values
    fits = np.empty((len(values), len(values)), bool)
    for low in range(0, len(values), 256):
        apart = turned[low:low + 256, None] ^ turned[None, :]
        good = np.ones(apart.shape, bool)
        for length, budget in enumerate(BUDGETS, 1):
            mask = np.uint64((1 << (WIDTH * length)) - 1)
            good &= np.bitwise_count(apart & mask) <= budget
        fits[low:low + 256] = good
    return fits


def print_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints at most three bits apart.

    `prints` holds distinct fp. Buckets of two are compared as columns, larger ones in blocks.
    """
    keyed = prints.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    shared = saved(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                   .filter("n > 1"), "buckets")
    pairs = shared.filter("n = 2").filter(chain_within_budget(F.col("a"), F.col("b"), F.col("key"))).select("a", "b")
    large = shared.filter("n > 2").select("key", "n")
    members = keyed.join(large, "key").select("key", "n", F.col("fp").alias("member"))
    return pairs.distinct().unionByName(bucket_links(members, within_budget))


def print_components(rows: DataFrame, first: Column) -> DataFrame:
    """fp and `lowest`: the smallest value of `first` among all rows of the fingerprint's component."""
    prints = saved(rows.groupBy("fp").agg(F.min(first).alias("first")), "prints")
    linked = components(print_links(prints.select("fp"))).withColumnRenamed("node", "fp")
    named = saved(prints.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    return named.join(lowest, "component").select("fp", "lowest")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id it is linked to.

    Rows with equal fingerprints are one node, so copies cost nothing. Texts without words have fingerprint
    zero. A row without an id takes part; its component_id is null only if no linked row has an id. doc_id is a long. A text is
    held whole by one task, whatever its length. Other columns are not read, whatever their names.
    """
    rows = saved(fingerprints(numbered(docs, ["doc_id", "text"])), "fingerprints")
    return rows.join(print_components(rows, F.col("doc_id")), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("lowest").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with their own columns, that come first in their component.

    First is the smallest doc_id, rows without an id last and rows that share an id by their place. All texts
    without words are one group.
    """
    kept = saved(docs.select(F.monotonically_increasing_id().alias("row_no"), row_of(docs).alias("doc")), "documents")
    rows = saved(fingerprints(kept.select("row_no", "doc.doc_id", "doc.text")), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    stay = print_components(rows, place).select(F.col("lowest.row_no").alias("row_no")).distinct()
    return kept.join(stay, "row_no", "left_semi").select("doc.*")
