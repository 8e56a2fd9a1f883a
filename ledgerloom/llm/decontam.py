"""Benchmark decontamination by winnowing.

Words are hashed, k neighbouring words make a k-gram hash, and of every window of w k-gram hashes the
smallest is kept with its position. Two texts that share k + w - 1 words keep the same hash at the same
place in them, so joining the kept hashes of documents and items finds every such span. Hits are then
extended word by word to both sides and count only where at least that many words agree, so a collision
of hashes never counts.

Items shorter than the span are one window of their own length; they get a class of their own with a
span of that length, and documents keep the hashes of each class that exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import chunked, in_tasks, numbered, row_of, saved, text_buffer

SPAN = 13
GRAM = 5
FILTER_BITS = 23
SALTS = 16
SPREAD = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
GRAM_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
BACK_STEP = np.uint64(pow(int(GRAM_STEP), -1, 1 << 64))

FOUND = ("row_no long, doc_id long, n_words long, hits array<struct<span: int, hash: long, place: int, "
         "before: array<string>, after: array<string>>>")


def _word_table() -> np.ndarray:
    """What each byte counts as: 0 between words, else itself with A-Z lower-cased."""
    table = np.zeros(256, np.uint8)
    table[0x30:0x3A] = np.arange(0x30, 0x3A)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


WORD_BYTES = _word_table()


def mixed(values: np.ndarray) -> np.ndarray:
    """A well spread permutation of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of every word, and the first word number of every text."""
    lower = WORD_BYTES[data]
    is_word = np.zeros(len(lower) + 2, bool)
    is_word[1:-1] = lower != 0
    begins = is_word[1:-1] & ~is_word[:-2]
    inner = offsets[(offsets > 0) & (offsets < len(lower))]
    begins[inner] = is_word[inner + 1]
    ends = is_word[1:-1] & ~is_word[2:]
    ends[inner - 1] = is_word[inner]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return lower, starts, stops, np.searchsorted(starts, offsets)


def word_hashes(lower: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word from its bytes and their places in it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = stops - starts
    powers = np.cumprod(np.full(int(sizes.max()), STEP, np.uint64))
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters = lower[np.repeat(starts, sizes) + within]
    sums = np.add.reduceat(SPREAD[letters] * powers[within], np.cumsum(sizes) - sizes)
    return mixed(sums)


def winnowed(words: np.ndarray, firsts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the window minima of all texts, leftmost among equals."""
    gram = min(span, GRAM)
    window = span - gram + 1
    if len(words) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for place in range(gram):
        grams = grams * GRAM_STEP + words[place: place + len(grams)]
    grams = mixed(grams + np.uint64(span))
    n = len(grams) - window + 1
    best, at = grams[:n].copy(), np.arange(n)
    for shift in range(1, window):
        other = grams[shift: shift + n]
        less = other < best
        best = np.where(less, other, best)
        at = np.where(less, np.arange(shift, shift + n), at)
    sizes = np.diff(firsts)
    room = np.repeat(firsts[1:], sizes)[:n] - np.arange(n)
    places = np.unique(at[room >= span])
    return places, grams[places]


def _strings(lower: bytes, starts: list[int], stops: list[int], low: int, high: int) -> list[str]:
    return [lower[starts[i]:stops[i]].decode() for i in range(low, high)]


def _fingerprints(batch: pa.RecordBatch, spans: list[int], keep: np.ndarray | None) -> Iterator[dict]:
    """Per text: its words and, for each span class, the kept hashes with the words around them.

    Without `keep` the texts are items: each belongs to the class of its own length only.
    """
    lower, starts, stops, firsts = words_of(*text_buffer(batch.column("text")))
    words = word_hashes(lower, starts, stops)
    raw, begin, end = lower.tobytes(), starts.tolist(), stops.tolist()
    hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    for span in spans:
        places, hashes = winnowed(words, firsts, span)
        texts = np.searchsorted(firsts, places, "right") - 1
        if keep is None:
            mine = np.minimum(firsts[texts + 1] - firsts[texts], SPAN) == span
        else:
            slot = hashes >> np.uint64(64 - FILTER_BITS)
            mine = (keep[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
        reach = span - min(span, GRAM)
        for place, value, text in zip(places[mine].tolist(), hashes[mine].view(np.int64).tolist(), texts[mine].tolist()):
            low, high = int(firsts[text]), int(firsts[text + 1])
            hits[text].append({
                "span": span, "hash": value, "place": place - low,
                "before": _strings(raw, begin, end, max(low, place - reach), place)[::-1],
                "after": _strings(raw, begin, end, place, min(high, place + span))})
    keys = zip(batch.column("row_no").to_pylist(), batch.column("doc_id").to_pylist())
    for (row, doc), count, found in zip(keys, np.diff(firsts).tolist(), hits):
        yield {"row_no": row, "doc_id": doc, "n_words": count, "hits": found}


HIT = pa.struct([("span", pa.int32()), ("hash", pa.int64()), ("place", pa.int32()),
                 ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
FOUND_ARROW = pa.schema([("row_no", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(HIT))])


def _search(spans: list[int], keep: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in chunked(batches, "text", 1 << 20):
        yield pa.RecordBatch.from_pylist(list(_fingerprints(piece, spans, keep)), FOUND_ARROW)


def _hash_filter(items: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits (1 MB) that holds every hash of the items.

    It only spares documents' hashes that no item has; the join decides. Its size does not depend on
    the number of items: many items merely let more hashes through.
    """
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    rows = (
        items.groupBy(F.shiftright(slot, 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    )
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bitmap[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bitmap


def _agreeing(left: Column, right: Column) -> Column:
    """How many leading words of two arrays are equal."""
    same = F.zip_with(left, right, lambda a, b: a.eqNullSafe(b))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("long"))


def hit_spans(docs: DataFrame, items: DataFrame, item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Rows with their word counts, and the shared spans: row_no, item, start (first word), stop (past the last).

    `docs` has row_no, doc_id and text, `items` has the id and text. Null texts have no words. A passage common to
    a third of the documents is dealt by SALTS salts, with the items' few hashes copied to each.
    """
    marked = numbered(items, [item_id, "text"])
    every = list(range(1, SPAN + 1))
    found = marked.select("row_no", F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(in_tasks(_search, every, None), FOUND)
    stored = saved(found.join(marked.select("row_no", F.col(item_id).alias("item")), "row_no")
                   .select("item", F.inline("hits")).drop("place"), "items")
    spans = sorted(r.span for r in stored.select("span").distinct().collect())
    rows = saved(docs.select("row_no", "doc_id", "text").mapInArrow(in_tasks(_search, spans, _hash_filter(stored)), FOUND), "hits")
    left = rows.select("row_no", F.inline("hits")).withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(SALTS)))
    right = (
        stored.groupBy("span", "hash", "before", "after").agg(F.collect_set(F.struct("item")).alias("items"))
        .select("span", "hash", F.col("before").alias("item_before"), F.col("after").alias("item_after"), "items",
                F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    )
    met = left.join(right, ["span", "hash", "salt"]).select(
        "row_no", "items", "place", "span",
        _agreeing(F.col("before"), F.col("item_before")).alias("back"),
        _agreeing(F.col("after"), F.col("item_after")).alias("ahead"))
    spans_hit = met.filter(F.col("back") + F.col("ahead") >= F.col("span")).select(
        "row_no", F.inline("items"), (F.col("place") - F.col("back")).alias("start"),
        (F.col("place") + F.col("ahead")).alias("stop"))
    return rows.select("row_no", "doc_id", "n_words"), spans_hit.distinct()


def covered(spans: DataFrame, key: str = "row_no") -> DataFrame:
    """Per key, how many places its (start, stop) spans cover together."""
    earlier = Window.partitionBy(key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(earlier), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reached))
    return (
        spans.select(key, "start", "stop").distinct().select(key, fresh.alias("fresh"))
        .groupBy(key).agg(F.sum("fresh").alias("n_hit"))
    )


def _verdict(n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit that lies in an occurrence of SPAN consecutive words of an item, or of a whole shorter
    item. A document is contaminated if a twentieth of its words are hit. Documents without words,
    and all documents where the benchmark is empty, have no hits. Rows that repeat an id, or have none,
    are judged each on its own.
    """
    counts, spans = hit_spans(numbered(docs, ["doc_id", "text"]), benchmark)
    spans = saved(spans, "spans")
    items = (
        spans.select("row_no", "item").distinct().groupBy("row_no")
        .agg(F.count("*").alias("n_items"),
             F.concat_ws(",", F.array_sort(F.collect_list(F.col("item").cast("string")))).alias("names"))
    )
    joined = counts.join(covered(spans), "row_no", "left").join(items, "row_no", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
        _verdict(n_hit).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with their own columns, that are not contaminated."""
    kept = saved(docs.select(F.monotonically_increasing_id().alias("row_no"), row_of(docs).alias("doc")), "documents")
    counts, spans = hit_spans(kept.select("row_no", "doc.doc_id", "doc.text"), benchmark)
    bad = counts.join(covered(spans), "row_no").filter(_verdict(F.col("n_hit"))).select("row_no")
    return kept.join(bad, "row_no", "left_anti").select("doc.*")
