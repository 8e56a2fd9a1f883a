"""Repeated passages across documents by MinHash banding of paragraphs.

A paragraph is a line of at least MIN_WORDS words, or a block: texts are also cut, across line breaks and inside long
lines, before every word whose hash is the smallest among CUT_RADIUS words to either side. Blocks between two
cuts are over CUT_RADIUS words, so one changed word leaves them above the threshold. Bands of MinHash values are tuned for a recall at the
threshold. Paragraphs with the same words are one class; classes that share a band are verified by the
exact Jaccard index of their five-word shingles, and linked classes form components. The document with
the smallest id keeps a component's passage.

A passage may also be set into other text, in one line or over several. Texts therefore have inner paragraphs as
well, cut over their words whatever the line breaks: of every WINDOW neighbouring stretches of INNER_WORDS words the
one with the smallest hash. Texts that share INNER_WORDS + WINDOW - 1 words so share an inner paragraph at the same
place in them, and neighbouring ones overlap. Inner paragraphs match by equal words. Overlapping hits are one run; the
texts are then read again for the words beside the ends of runs, by which a run is extended word by word to its
true ends. Two runs that lie at most MAX_GAP words apart in both texts are one passage if their shingles make
the threshold.

Of an inner paragraph only its hash, text and place are stored. Hashes and bands met once are dropped by counts that combine
before the shuffle. Tables that nothing reads any more are deleted on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.buckets import bucket_links
from ledgerloom.llm.components import components
from ledgerloom.llm.decontam import BACK_STEP, GRAM_STEP, mixed, word_hashes, words_of
from ledgerloom.llm.shared import chunked, dropped, in_tasks, saved, text_buffer

SHINGLE = 5
THRESHOLD = 0.8
MIN_WORDS = 25
INNER_WORDS = 16
WINDOW = 15
REACH = WINDOW - 1
CUT_RADIUS = 49
MAX_GAP = 5
MIN_PASSAGE = 30
ROWS_PER_BAND = 2
RECALL = 0.999
FILTER_BITS = 26
FACTORS = np.random.Generator(np.random.PCG64(23)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def bands_for(threshold: float, recall: float, rows: int = ROWS_PER_BAND) -> int:
    """The fewest bands of `rows` values each that find a pair at the threshold with the recall."""
    bands = 1
    while 1 - (1 - threshold ** rows) ** bands < recall:
        bands += 1
    return bands


BANDS = bands_for(THRESHOLD, RECALL)


class Paragraphs:
    """All paragraphs of a chunk of texts: whole lines and blocks (`lines` of them) first, then, if asked for, the inner ones."""

    def __init__(self, texts: pa.Array, keyed: bool = True):
        data, offsets = text_buffer(texts)
        lower, self.begin, self.end, self.firsts = words_of(data, offsets)
        self.offsets = offsets
        self.words = words = word_hashes(lower, self.begin, self.end)
        n = len(words)
        line = np.concatenate([[0], np.cumsum(data == 0x0A)])[self.begin]
        last = np.ones(n, bool)
        last[:-1] = line[1:] != line[:-1]
        last[self.firsts[(self.firsts > 0) & (self.firsts <= n)] - 1] = True
        line_ends = np.flatnonzero(last) + 1
        line_starts = np.concatenate([[0], line_ends[:-1]])[: len(line_ends)]
        long = line_ends - line_starts >= MIN_WORDS
        self._hash(words)
        blocks = self._blocks()
        inner = self._inner() if keyed else np.zeros(0, np.int64)
        self.whole = int(long.sum())
        self.lines = self.whole + len(blocks)
        self.starts = np.concatenate([line_starts[long], blocks[:, 0], inner])
        self.stops = np.concatenate([line_ends[long], blocks[:, 1], inner + INNER_WORDS])
        if keyed:
            self._bands(self.lines)

    def _hash(self, words: np.ndarray) -> None:
        """Hashes of the shingles, and running sums from which a stretch of words gets its hash."""
        n = len(words)
        grams = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
        for place in range(SHINGLE):
            grams = grams * GRAM_STEP + words[place: place + len(grams)]
        self.grams = mixed(grams)
        powers = np.cumprod(np.full(n, GRAM_STEP, np.uint64))
        self.back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BACK_STEP, np.uint64))])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers, dtype=np.uint64)])

    def _blocks(self) -> np.ndarray:
        """Start and stop of the stretches of at least MIN_WORDS words between two cuts of a text."""
        n, sizes = len(self.words), np.diff(self.firsts)
        place = np.arange(n) + (np.repeat(np.arange(len(sizes)), sizes) + 1) * CUT_RADIUS
        least = np.full(n + (len(sizes) + 2) * CUT_RADIUS, np.uint64(2**64 - 1))
        least[place] = self.words
        width = 1
        while width < CUT_RADIUS:
            step = min(width, CUT_RADIUS - width)
            least[:-step] = np.minimum(least[:-step], least[step:])
            width += step
        cuts = np.flatnonzero((self.words < least[place - CUT_RADIUS]) & (self.words <= least[place + 1]))
        bounds = np.unique(np.concatenate([cuts, self.firsts]))
        spans = np.stack([bounds[:-1], bounds[1:]], axis=1).astype(np.int64)
        return spans[spans[:, 1] - spans[:, 0] >= MIN_WORDS]

    def _inner(self) -> np.ndarray:
        """Where the window minima of the stretches of INNER_WORDS words begin, leftmost among equals."""
        n = len(self.words) - INNER_WORDS - WINDOW + 2
        if n < 1:
            return np.zeros(0, np.int64)
        starts = np.arange(n + WINDOW - 1)
        hashes = self._contents(starts, starts + INNER_WORDS)
        at = np.arange(n) + np.argmin(np.lib.stride_tricks.sliding_window_view(hashes, WINDOW), axis=1)
        room = np.repeat(self.firsts[1:], np.diff(self.firsts))[:n] - np.arange(n)
        return np.unique(at[room >= INNER_WORDS + WINDOW - 1])

    def _bands(self, lines: int) -> None:
        """Keys of all paragraphs; inner ones have a single key.

        Lines and blocks have bands of their own, or the two that overlap in a text would fill each other's buckets.
        """
        n = len(self.starts)
        self.keys, self.valid = np.zeros((n, BANDS), np.uint64), np.zeros((n, BANDS), bool)
        self.valid[:lines], self.valid[lines:, 0] = True, True
        for band in range(BANDS):
            key = np.where(np.arange(lines) < self.whole, band + 1, BANDS + band + 2).astype(np.uint64)
            for row in range(ROWS_PER_BAND):
                number = band * ROWS_PER_BAND + row
                smallest = np.concatenate([self._smallest(number, self.starts[a:b], self.stops[a:b])
                                           for a, b in ((0, self.whole), (self.whole, lines))])
                key = mixed(key * GRAM_STEP + smallest)
            self.keys[:lines, band] = key
        self.keys[lines:, 0] = mixed(self.contents(np.arange(lines, n)) + np.uint64(BANDS + 1))

    def _smallest(self, number: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        spread = np.append(mixed(self.grams * FACTORS[number]), np.uint64(2**64 - 1))
        bounds = np.stack([starts, stops - SHINGLE + 1], axis=1).ravel()
        return np.minimum.reduceat(spread, bounds)[::2]

    def contents(self, which: np.ndarray) -> np.ndarray:
        """A hash of the words of the chosen paragraphs in their order; lines and inner paragraphs are apart."""
        hashes = self._contents(self.starts[which], self.stops[which])
        return np.where(which < self.lines, hashes, mixed(hashes + np.uint64(1)))

    def _contents(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stops] - self.sums[starts]) * self.back[starts] + (stops - starts).astype(np.uint64))

    def rows(self, which: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, self.starts[which], "right") - 1


def in_bitmap(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = values >> np.uint64(64 - FILTER_BITS)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def bitmap_of(rows: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits (8 MB) of the leading bits of a column of longs.

    It spares reading back what cannot match; a full bitmap spares nothing but loses nothing either.
    """
    slot = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    words = rows.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function(
        "shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bitmap


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every paragraph: the text's number, id and hash, first and last word, content, and the bands of lines and blocks.

    Of inner ones only number, first word and content.
    """
    row_base = TaskContext.get().partitionId() << 33
    for piece in chunked(batches, "text", 1 << 20):
        found = Paragraphs(piece.column("text"))
        n, lines = len(found.starts), found.lines
        which = np.arange(n)
        rows = found.rows(which)
        firsts = found.firsts[rows]
        inner = which >= lines
        ends = np.minimum(np.arange(n + 1), lines) * BANDS
        bands = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(inner, False)),
                                         pa.array(found.keys[:lines].ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([
            pa.array(rows + row_base), pa.array((found.starts - firsts).astype(np.int32)),
            pa.array((found.stops - firsts).astype(np.int32), mask=inner),
            pa.array(found.contents(which).view(np.int64)), bands],
            ["row_no", "start", "stop", "content", "keys"])
        # One row more for each text: who it is.
        every = np.arange(piece.num_rows)
        nothing = pa.nulls(piece.num_rows, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(every + row_base), nothing, nothing, pa.nulls(piece.num_rows, pa.int64()), pa.array(
            [[key, 0 if doc is None else doc, int(doc is None)] for key, doc in zip(piece.column("text_key").to_pylist(), piece.column("doc_id").to_pylist())],
            pa.list_(pa.int64()))], ["row_no", "start", "stop", "content", "keys"])
        row_base += piece.num_rows


UNITS = "row_no long, start int, stop int, content long, keys array<long>"


def _shingles(wanted: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content and sorted distinct shingles of the lines and blocks whose content is in `wanted`, once per chunk."""
    for piece in chunked(batches, "text", 1 << 20):
        found = Paragraphs(piece.column("text"), keyed=False)
        contents, places = np.unique(found.contents(np.arange(found.lines)), return_index=True)
        mine = in_bitmap(contents, wanted)
        which, contents = places[mine], contents[mine]
        sets = [np.unique(found.grams[a:b - SHINGLE + 1]).view(np.int64)
                for a, b in zip(found.starts[which], found.stops[which])]
        yield pa.RecordBatch.from_arrays([pa.array(contents.view(np.int64)), pa.array(sets, pa.list_(pa.int64()))],
                                         ["content", "shingles"])


SIDES = "text_key long, place int, ahead boolean, byte int, side array<long>"


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the asked places of texts, where a run begins or (`ahead`) ends: its byte, and up to REACH words beyond it, nearest first.

    A word is 32 bits of its hash, and above them the bytes from the place to its far end.
    """
    for piece in chunked(batches, "text", 1 << 20):
        data, offsets = text_buffer(piece.column("text"))
        lower, begin, end, firsts = words_of(data, offsets)
        words = (word_hashes(lower, begin, end) >> np.uint64(32)).astype(np.int64)
        asked = piece.column("asked")
        rows = np.repeat(np.arange(piece.num_rows), np.diff(np.asarray(asked.offsets)))
        flat = asked.flatten()
        place, ahead = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("place", "ahead"))
        edge = firsts[rows] + np.where(ahead, place - 1, place)
        sizes = np.where(ahead, np.minimum(firsts[rows + 1] - 1 - edge, REACH), np.minimum(edge - firsts[rows], REACH))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        base, forth = np.repeat(edge, sizes), np.repeat(ahead, sizes)
        at = base + np.where(forth, 1, -1) * (np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes) + 1)
        ends = np.where(forth, end[at] - end[base], begin[base] - begin[at])
        byte = np.where(ahead, end[edge], begin[edge]) - offsets[rows]
        yield pa.RecordBatch.from_arrays([
            piece.column("text_key").take(pa.array(rows)), pa.array(place, pa.int32()), pa.array(ahead, pa.bool_()),
            pa.array(byte.astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ends.astype(np.int64) << 32 | words[at]))],
            ["text_key", "place", "ahead", "byte", "side"])


def similar(group: pa.Table, threshold: float) -> np.ndarray:
    """Which members of a bucket have a Jaccard index of the threshold or more, counted exactly."""
    lists = group.column("shingles").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values, offsets = lists.flatten().to_numpy(), np.asarray(lists.offsets)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    same, owners = values[order], owner[order]
    change = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    run_of = np.empty(len(values), np.int64)
    run_of[order] = np.repeat(np.arange(len(change)), np.diff(np.append(change, len(values))))
    run_ends = np.append(change[1:], len(values))
    linked = np.zeros((n, n), bool)
    for member in range(n):
        runs = run_of[offsets[member]:offsets[member + 1]]
        if not len(runs):
            continue
        met = np.concatenate([owners[a:b] for a, b in zip(change[runs], run_ends[runs])])
        common = np.bincount(met, minlength=n)
        linked[member] = common >= threshold * (sizes[member] + sizes - common) - 1e-9
    return linked


def paragraph_components(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """content and component of every class of lines and blocks that is linked to another."""
    banded = lines.select("content", F.explode("keys").alias("key"))
    shared = saved(banded.groupBy("key").agg(F.min("content").alias("low"), F.max("content").alias("high"))
                   .filter("low <> high").select("key"), "shared")
    met = saved(banded.join(shared, "key").distinct(), "bands")
    members = saved(met.join(met.groupBy("key").agg(F.count("*").alias("n")), "key"), "members")
    sets = docs.select("text").mapInArrow(
        in_tasks(_shingles, bitmap_of(members.select("content").distinct(), "content")), "content long, shingles array<long>")
    sets = saved(sets.groupBy("content").agg(F.any_value("shingles").alias("shingles")), "shingles")
    joined = members.join(sets, "content").select("key", "n", F.col("content").alias("member"), "shingles")
    linked = components(bucket_links(joined, similar, (THRESHOLD,)))  # its first step has written the links
    dropped(shared, met, members, sets)
    return linked


def _agreeing(own: Column, other: Column) -> Column:
    """How many words of two sides agree, and the bytes of the own ones."""
    same = F.zip_with(own, other, lambda x, y: F.coalesce(x.bitwiseAND(0xFFFFFFFF) == y.bitwiseAND(0xFFFFFFFF), F.lit(False)))
    n = F.coalesce(F.array_position(F.array_append(same, F.lit(False)), F.lit(False)) - 1, F.lit(0)).cast("int")
    return F.struct(n.alias("words"), F.coalesce(F.shiftright(F.get(own, n - 1), 32), F.lit(0)).cast("int").alias("bytes"))


def joined_runs(hits: DataFrame) -> DataFrame:
    """Overlapping and touching hits of a text as one run each, with the first and the last hit."""
    by_text = Window.partitionBy("row_no").orderBy("start", "stop")
    reached = F.max("stop").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.withColumn("fresh", (F.coalesce(reached, F.lit(-1)) < F.col("start")).cast("int")) \
        .withColumn("island", F.sum("fresh").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("row_no", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("keep").alias("keep"),
        F.min(F.struct("start", F.col("keep.row_no").alias("row_no"), "keep_start", "inner")).alias("head"),
        F.max(F.struct("stop", F.col("keep.row_no").alias("row_no"), "keep_stop", "inner")).alias("tail"))


def extended(runs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Runs to the ends of what agrees with the earlier text of their first and last hit, with their bytes.

    `texts` has row_no, doc_id and text_key. Words are fetched for the ends of runs alone, once for equal texts.
    """
    own = texts.select("row_no", "doc_id", F.col("text_key").alias("own_key"))
    runs = saved(
        runs.join(own, "row_no")
        .join(texts.select(F.col("row_no").alias("head_row"), F.col("text_key").alias("head_key")), F.col("head.row_no") == F.col("head_row"))
        .join(texts.select(F.col("row_no").alias("tail_row"), F.col("text_key").alias("tail_key")), F.col("tail.row_no") == F.col("tail_row"))
        .drop("head_row", "tail_row"), "runs")

    def ask(key: str, place: str, ahead: bool) -> Column:
        return F.struct(F.col(key).alias("text_key"), F.col(place).cast("int").alias("place"), F.lit(ahead).alias("ahead"))

    wanted = runs.select(F.inline(F.array(
        ask("own_key", "start", False), ask("own_key", "stop", True), ask("head_key", "head.keep_start", False),
        ask("tail_key", "tail.keep_stop", True)))).distinct()
    asked = saved(wanted.groupBy("text_key").agg(F.collect_list(F.struct("place", "ahead")).alias("asked")), "asked")
    once = docs.select("text", F.xxhash64("text").alias("text_key")).join(asked.select("text_key"), "text_key", "left_semi") \
        .groupBy("text_key").agg(F.first("text").alias("text"))
    sides = saved(once.join(asked, "text_key").select("text", "text_key", "asked").mapInArrow(in_tasks(_sides), SIDES), "sides")

    def side(ahead: bool, key: str, place: str, name: str) -> DataFrame:
        return sides.filter(F.col("ahead") == ahead).select(
            F.col("text_key").alias(key), F.col("place").alias(place), F.col("byte").alias(f"{name}_byte"), F.col("side").alias(f"{name}_side"))

    flat = runs.withColumns({"head_place": F.col("head.keep_start"), "tail_place": F.col("tail.keep_stop")})
    for part in (side(False, "own_key", "start", "start"), side(True, "own_key", "stop", "stop"),
                 side(False, "head_key", "head_place", "first"), side(True, "tail_key", "tail_place", "last")):
        flat = flat.join(part, part.columns[:2])
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("bytes"))
    left = F.when(F.col("head.inner"), _agreeing(F.col("start_side"), F.col("first_side"))).otherwise(none)
    right = F.when(F.col("tail.inner"), _agreeing(F.col("stop_side"), F.col("last_side"))).otherwise(none)
    sized = flat.withColumns({"left": left, "right": right})
    return sized.select(
        "row_no", "doc_id", "keep", (F.col("start") - F.col("left.words")).alias("start"), (F.col("stop") + F.col("right.words")).alias("stop"),
        (F.col("start_byte") - F.col("left.bytes")).alias("start_byte"), (F.col("stop_byte") + F.col("right.bytes")).alias("stop_byte"),
        F.struct(F.col("head.row_no").alias("row_no"), (F.col("head.keep_start") - F.col("left.words")).alias("keep_start")).alias("head"),
        F.struct(F.col("tail.row_no").alias("row_no"), (F.col("tail.keep_stop") + F.col("right.words")).alias("keep_stop")).alias("tail"))


def widened(runs: DataFrame) -> DataFrame:
    """Runs that touch each other since they were extended, as one."""
    by_text = Window.partitionBy("row_no").orderBy("start", "stop")
    reached = F.max("stop").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("fresh", (F.coalesce(reached, F.lit(-1)) < F.col("start")).cast("int")) \
        .withColumn("island", F.sum("fresh").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("row_no", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.min("start_byte").alias("start_byte"), F.max("stop_byte").alias("stop_byte"), F.min("keep").alias("keep"),
        F.min_by("head", "start").alias("head"), F.max_by("tail", "stop").alias("tail"))


def passages_of(runs: DataFrame) -> DataFrame:
    """Passages of runs: neighbours with the threshold's share of shingles and MAX_GAP words or less between become one.

    Both must go on in the same earlier text. The shingles of the runs are the common ones, those over the gap are not.
    """
    by_text = Window.partitionBy("row_no").orderBy("start")
    before = F.lag(F.struct("start", "stop", "tail")).over(by_text)
    gap = F.col("start") - F.col("before.stop")
    keep_gap = F.col("head.keep_start") - F.col("before.tail.keep_stop")
    words = F.col("stop") - F.col("before.start")
    common = words - gap - 2 * (SHINGLE - 1)
    total = 2 * words - gap + keep_gap - 2 * (SHINGLE - 1)
    near = ((F.col("head.row_no") == F.col("before.tail.row_no")) & (gap <= MAX_GAP) & keep_gap.between(0, MAX_GAP)
            & (common >= THRESHOLD * (total - common)))
    chains = runs.withColumn("before", before).withColumn("fresh", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)) \
        .withColumn("chain", F.sum("fresh").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    return chains.groupBy("row_no", "chain").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.min("start_byte").alias("start_byte"), F.max("stop_byte").alias("stop_byte"), F.min("keep")["doc_id"].alias("keep_id"))


def repeated_passages(docs: DataFrame, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """One row per passage to remove: doc_id, start and stop (words), start_byte and stop_byte, n_words, keep_id.

    A paragraph goes where its component occurs in a document before, by doc_id (a missing id last, rows that
    share an id by their place). Hits are extended to the ends of what agrees; overlapping and touching ones of a
    document make one passage, also over a gap of changed words; passages under `min_passage` words stay. keep_id is the first document that keeps a paragraph of the passage.
    Repeats inside one document, null and short texts give no rows. doc_id is a long; other columns are not read, whatever their
    names. A text is held whole by one task, whatever its length.
    """
    docs = docs.select("doc_id", "text")
    units = saved(docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(in_tasks(_units), UNITS), "units")
    texts = saved(units.filter("start IS NULL").select(
        "row_no", F.when(F.col("keys")[2] == 0, F.col("keys")[1]).alias("doc_id"), F.col("keys")[0].alias("text_key")), "texts")
    lines, inner = units.filter("stop IS NOT NULL"), units.filter("stop IS NULL AND start IS NOT NULL")
    linked = paragraph_components(lines, docs).withColumnRenamed("node", "content")

    classes = lines.select("row_no", "start", "stop", "content").join(linked, "content", "left").select(
        F.coalesce("component", "content").alias("component"), "row_no", "start", "stop", F.lit(False).alias("inner"))
    stretches = inner.select(F.col("content").alias("component"), "row_no", "start").withColumns({
        "stop": F.col("start") + INNER_WORDS, "inner": F.lit(True)})
    every = classes.unionByName(stretches)
    twice = every.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    grouped = saved(every.join(twice, "component").join(texts.select("row_no", "doc_id"), "row_no")
                    .select("component", place.alias("place"), "start", "stop", "inner"), "grouped")
    dropped(units)
    first = saved(grouped.groupBy("component").agg(F.min(F.struct("place", "start", "stop")).alias("first"), F.max("place").alias("last"))
                  .filter("first.place <> last").drop("last"), "first")
    gone = grouped.join(first, "component").filter(F.col("place") > F.col("first.place")).select(
        "place.row_no", "start", "stop", "inner", F.col("first.place").alias("keep"),
        F.col("first.start").alias("keep_start"), F.col("first.stop").alias("keep_stop"))
    passages = passages_of(widened(extended(joined_runs(gone), texts, docs)))
    return passages.withColumn("n_words", (F.col("stop") - F.col("start")).cast("long")) \
        .filter(F.col("n_words") >= min_passage) \
        .select("doc_id", "start", "stop", "start_byte", "stop_byte", "n_words", "keep_id")
