"""Collocations: phrases of two to four words that occur together more than apart, counted in quotient filters.

Texts become blocks of word numbers. Words that are too rare for any phrase break a phrase like a full stop does, so only
frequent words have ids, and an n-gram is packed into four ids of as many bits as the largest id needs. The
packed n-gram is permuted by a Feistel network, which can be undone: its high bits, the quotient, say where in a sorted
filter it belongs, the rest is stored in full beside its counter. Nothing is approximated. A task fills a
filter from its blocks and cuts it by the highest bits; equal cuts of all tasks are merged and the frequent n-grams turned
back into ids. The permutation spreads n-grams evenly, and a task has one counter for each, so none is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import chunked, in_tasks, list_array, saved

MIN_COUNT = 30
TOP = 2000
ABSORBED_PERCENT = 80
#: A language's phrases are ranked in so many parts first, so that its one last ranking is of bounded size.
RANKED_PARTS = 64
#: Counters that a task holds before it hands its filter on, and that a merged cut may expect.
FILTER_ENTRIES = 1 << 20
BLOCK_BYTES, HELD_BYTES = 1 << 21, 1 << 23
LEAST_CUT_BITS = 5
LEAST_ID_BITS, MOST_ID_BITS = 8, 32
BREAKS = b".,;:!?\n\x0b\x0c\r"

_TABLE = bytearray(range(256))
for _i in range(26):
    _TABLE[65 + _i] = 97 + _i
for _byte in BREAKS:
    _TABLE[_byte] = 10
_TABLE[9] = 32
LOWER_AND_BREAK = bytes(_TABLE)

# Fixed odd multipliers and round keys of the permutation.
ROUNDS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


# ── blocks of word numbers ────────────────────────────────────────────────────

def word_numbers(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, their counts, and the words of all texts as numbers into them from 1, 0 between pieces."""
    data = b"\n".join(texts).translate(LOWER_AND_BREAK).replace(b"\n", b" \n ")
    coded = pa.array(data.split(b" "), pa.binary()).dictionary_encode()
    words, numbers = coded.dictionary, coded.indices.to_numpy()
    empty, stop = (words.index(mark).as_py() for mark in (b"", b"\n"))
    kept = np.setdiff1d(np.arange(len(words)), (empty, stop))
    place = np.zeros(len(words), np.int64)
    place[kept] = np.arange(1, len(kept) + 1)
    numbers = place[numbers[numbers != empty]]
    counts = np.bincount(numbers, minlength=len(kept) + 1)[1:].astype(np.int64)
    return words.take(pa.array(kept)), counts, numbers.astype("<u2" if len(kept) < 1 << 16 else "<u4")


def blocks_of(block_bytes: int, held_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts of one language; the largest is closed when a task holds more than `held_bytes` of all languages."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def close(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal block
        words, counts, numbers = word_numbers(held.pop(lang))
        sizes.pop(lang)
        block += 1
        if len(words):
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "lang": [lang],
                "words": list_array(words.cast(pa.string()), np.array([0, len(words)])),
                "counts": list_array(counts, np.array([0, len(counts)])),
                "numbers": pa.array([numbers.tobytes()], pa.binary()), "n": pa.array([int(counts.sum())], pa.int64())})

    for batch in chunked(batches, "text"):
        texts = batch.column("text").cast(pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            text = text.as_py()
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= block_bytes:
                yield from close(lang)
        while sum(sizes.values()) > held_bytes:
            yield from close(max(sizes, key=sizes.get))
    for lang in sorted(held):
        yield from close(lang)


# ── counting quotient filters ─────────────────────────────────────────────────

def _mix(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    x = (half + np.uint64(key >> 32)) * np.uint64(key | 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(ROUNDS[1])
    x ^= x >> np.uint64(32)
    return x >> np.uint64(64 - bits)


def permuted(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of `bits` bits each, permuted; `restored` undoes it."""
    for key in ROUNDS:
        left, right = right, left ^ _mix(right, key, bits)
    return left, right


def restored(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    for key in reversed(ROUNDS):
        left, right = right ^ _mix(left, key, bits), left
    return left, right


def tally(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, bits: int):
    """Sorted distinct keys and the sums of their counts (each one, where none are given); short halves come as 32 bits."""
    total = len(left)
    if not total:
        return left, right, np.zeros(0, np.int64)
    if 2 * bits <= 64:
        key = left.astype(np.uint64) << np.uint64(bits)
        key |= right
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key = key[starts]
        left, right = (key >> np.uint64(bits)).astype(np.uint32), (key & np.uint64((1 << bits) - 1)).astype(np.uint32)
    else:
        order = np.lexsort((right, left))
        left, right, counts = left[order], right[order], None if counts is None else counts[order]
        starts = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
        left, right = left[starts], right[starts]
    sums = np.diff(np.append(starts, total)).astype(np.int64) if counts is None else np.add.reduceat(counts, starts)
    return left, right, sums


def to_bytes(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_bytes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    return out.view("<u8").reshape(n).astype(np.uint64)


def packed_filter(left: np.ndarray, right: np.ndarray, counts: np.ndarray, bits: int, cut_bits: int) -> bytes:
    """A filter of one cut from sorted keys: which quotients occur, where runs of a quotient end, remainders, counters.

    Of a key that occurs once a bit says so; other counters are one byte, and those of 255 and more are told in full at the end.
    """
    n = len(left)
    q = max(0, min(int(n).bit_length(), bits - cut_bits, 30))
    rest = bits - cut_bits - q
    left, right = left.astype(np.uint64), right.astype(np.uint64)
    inside = left & np.uint64((1 << (bits - cut_bits)) - 1)
    quotient = (inside >> np.uint64(rest)).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.concatenate((quotient[1:] != quotient[:-1], [True]))
    again = counts[counts > 1]
    return b"".join((
        np.array([n, q], "<u4").tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(counts > 1).tobytes(),
        to_bytes(inside & np.uint64((1 << rest) - 1), (rest + 7) // 8), to_bytes(right, (bits + 7) // 8),
        np.minimum(again, 255).astype(np.uint8).tobytes(), again[again >= 255].astype("<i8").tobytes()))


def unpacked_filter(data: bytes, bits: int, cut_bits: int, cut: int):
    """The sorted keys and counts of a filter."""
    view = memoryview(data)
    n, q = (int(v) for v in np.frombuffer(view, "<u4", 2))
    rest = bits - cut_bits - q
    at = 8

    def take(size: int) -> memoryview:
        nonlocal at
        at += size
        return view[at - size: at]

    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(take(((1 << q) + 7) // 8), np.uint8))[: 1 << q])
    ends = np.unpackbits(np.frombuffer(take((n + 7) // 8), np.uint8))[:n]
    run = np.concatenate(([0], np.cumsum(ends)[:-1])).astype(np.int64)
    repeated = np.unpackbits(np.frombuffer(take((n + 7) // 8), np.uint8))[:n] == 1
    low = from_bytes(take(n * ((rest + 7) // 8)), n, (rest + 7) // 8)
    right = from_bytes(take(n * ((bits + 7) // 8)), n, (bits + 7) // 8)
    again = np.frombuffer(take(int(repeated.sum())), np.uint8).astype(np.int64)
    again[again == 255] = np.frombuffer(view[at:], "<i8")
    counts = np.ones(n, np.int64)
    counts[repeated] = again
    high = np.uint64(cut << (bits - cut_bits)) if cut_bits else np.uint64(0)
    left = high | (occupied[run].astype(np.uint64) << np.uint64(rest)) | low
    return left, right, counts


def half_bits(length: int, id_bits: int) -> int:
    """Bits of each half of a packed phrase of `length` words."""
    return (length * id_bits + 1) // 2


def n_grams(ids: np.ndarray, id_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Halves of the packed ids of all phrases of two, three and four words; id 0 is a break."""
    shift = np.uint64(id_bits)
    ids = np.concatenate((ids, np.zeros(3, np.uint64)))
    one, two, three, four = ids[:-3], ids[1:-2], ids[2:-1], ids[3:]
    at = np.flatnonzero((one > 0) & (two > 0))
    yield one[at], two[at]
    at = at[three[at] > 0]
    over = half_bits(3, id_bits) - id_bits  # bits of the second of three words that belong to the right half
    right = (two[at] & np.uint64((1 << over) - 1)) << shift | three[at]
    yield one[at] << np.uint64(id_bits - over) | two[at] >> np.uint64(over), right
    at = at[four[at] > 0]
    yield one[at] << shift | two[at], three[at] << shift | four[at]


def wide_ids(length: int, left: np.ndarray, right: np.ndarray, id_bits: int) -> list[np.ndarray]:
    """The ids of packed phrases, two to a number of 64 bits."""
    shift, mask = np.uint64(id_bits), np.uint64((1 << id_bits) - 1)
    none = np.zeros(len(left), np.uint64)
    if length == 2:
        ids = (left, right, none, none)
    elif length == 3:
        over = half_bits(3, id_bits) - id_bits
        second = (left & np.uint64((1 << (id_bits - over)) - 1)) << np.uint64(over) | right >> shift
        ids = (left >> np.uint64(id_bits - over), second, right & mask, none)
    else:
        ids = (left >> shift, left & mask, right >> shift, right & mask)
    return [(ids[i] << np.uint64(32) | ids[i + 1]).view(np.int64) for i in (0, 2)]


class Filter:
    """Counters of phrases of one length, as sorted runs that are merged when they have grown."""

    def __init__(self, length: int, id_bits: int):
        self.bits, self.parts, self.size = half_bits(length, id_bits), [], 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self.parts.append(tally(*permuted(left, right, self.bits), None, self.bits))
        self.size += len(self.parts[-1][0])

    def merge(self) -> int:
        if len(self.parts) > 1:
            self.parts = [merged(self.parts, self.bits)]
            self.size = len(self.parts[0][0])
        return self.size


def filters_of(id_bits: int, cut_bits: int, entries: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts of the filters that a task fills from its blocks."""
    def fresh() -> dict[int, Filter]:
        return {length: Filter(length, id_bits) for length in (2, 3, 4)}

    def flush() -> Iterator[pa.RecordBatch]:
        for length, counters in held.items():
            if not counters.merge():
                continue
            bits, (left, right, counts) = counters.bits, counters.parts[0]
            cuts = (left.astype(np.uint64) >> np.uint64(bits - cut_bits)).astype(np.int64)
            names = np.unique(cuts)
            bounds = np.append(np.searchsorted(cuts, names), len(cuts))
            for i in range(0, len(names), 64):
                yield pa.RecordBatch.from_pydict({
                    "cut": pa.array(names[i:i + 64] << 3 | length, pa.int64()),
                    "filter": pa.array([packed_filter(*(x[bounds[j]:bounds[j + 1]] for x in (left, right, counts)), bits, cut_bits)
                                        for j in range(i, min(i + 64, len(names)))], pa.binary())})

    held = fresh()
    for batch in batches:
        for row in range(batch.num_rows):
            width = batch.column("width")[row].as_py()
            numbers = np.frombuffer(batch.column("numbers")[row].as_py(), f"<u{width}")
            known = batch.column("ids")[row].values
            places = known.field("place").to_numpy()
            table = np.zeros(max(int(places.max(initial=0)), int(numbers.max(initial=0))) + 2, np.uint64)
            table[places + 1] = known.field("id").to_numpy()
            for counters, halves in zip(held.values(), n_grams(table[numbers], id_bits)):
                counters.add(*halves)
            if sum(c.size for c in held.values()) >= 2 * entries and sum(c.merge() for c in held.values()) >= entries:
                yield from flush()
                held = fresh()
    yield from flush()


def merged(parts: list, bits: int):
    if len(parts) == 1:
        return parts[0]
    return tally(*(np.concatenate(x) for x in zip(*parts)), bits)


def frequent_of(id_bits: int, cut_bits: int, least: int, entries: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the filters of each cut, which arrive one after the other, and turn frequent n-grams back into ids."""
    now, held = None, None

    def out() -> pa.RecordBatch:
        held.merge()
        left, right, counts = held.parts[0]
        often = counts >= least
        halves = (half[often].astype(np.uint64) for half in (left, right))
        wide = wide_ids(now & 7, *restored(*halves, held.bits), id_bits)
        return pa.RecordBatch.from_pydict({"hi": wide[0], "lo": wide[1], "a": counts[often]})

    for batch in batches:
        for cut, data in zip(batch.column("cut").to_pylist(), batch.column("filter")):
            if cut != now:
                if held:
                    yield out()
                now, held = cut, Filter(cut & 7, id_bits)
            held.parts.append(unpacked_filter(data.as_py(), held.bits, cut_bits, cut >> 3))
            held.size += len(held.parts[-1][0])
            if held.size >= 2 * entries:
                held.merge()
    if held:
        yield out()


# ── plan ──────────────────────────────────────────────────────────────────────

def word_ids(blocks: DataFrame, least: int) -> DataFrame:
    """lang, word, n and a dense id from 1 of the words that occur `least` times or more."""
    pairs = blocks.select("lang", F.inline(F.arrays_zip("words", "counts")))
    often = pairs.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("n")).filter(F.col("n") >= least)
    placed = saved(often.withColumn("place", F.monotonically_increasing_id()), "words")
    part, row = F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file that was written
    parts = placed.groupBy(part).agg(F.count("*").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    return placed.select("lang", "word", "n", part, row.alias("row")).join(parts, "part").select(
        "lang", "word", "n", (F.col("first") + F.col("row") + 1).alias("id"))


def frequent_phrases(blocks: DataFrame, vocabulary: DataFrame, least: int, entries: int, id_bits: int | None = None) -> DataFrame:
    """hi, lo (four ids of 32 bits each, 0 for none) and a, the count, of phrases that occur `least` times or more."""
    size = vocabulary.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    id_bits = id_bits or max(LEAST_ID_BITS, int(size.top).bit_length())
    if id_bits > MOST_ID_BITS:
        raise ValueError(f"{size.top} words occur {least} times or more; ids have {MOST_ID_BITS} bits")
    cut_bits = min(max(LEAST_CUT_BITS, (int(size.n) // entries).bit_length()), id_bits)
    coded = blocks.select("block", "lang", F.posexplode("words").alias("place", "word")).join(vocabulary, ["lang", "word"]) \
        .groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("ids"))
    width = F.when(F.size("words") < 1 << 16, 2).otherwise(4).alias("width")
    filters = blocks.select("block", "numbers", width).join(coded, "block").select("numbers", "width", "ids").mapInArrow(
        in_tasks(filters_of, id_bits, cut_bits, entries), "cut long, filter binary")
    return filters.repartition("cut").sortWithinPartitions("cut").mapInArrow(
        in_tasks(frequent_of, id_bits, cut_bits, least, entries), "hi long, lo long, a long")


def _word(place: int) -> Column:
    half = F.col("hi" if place <= 2 else "lo")
    return F.shiftrightunsigned(half, 32) if place % 2 else half.bitwiseAND(0xFFFFFFFF)


def _packed(*places: int) -> Column:
    """The key of the phrase of the words at these places."""
    words = [_word(p) for p in places] + [F.lit(0).cast("long")] * (4 - len(places))
    return F.struct(F.shiftleft(words[0], 32).bitwiseOR(words[1]).alias("hi"), F.shiftleft(words[2], 32).bitwiseOR(words[3]).alias("lo"))


def _by_length(of: dict[int, Column]) -> Column:
    return F.when(_word(4) != 0, of[4]).when(_word(3) != 0, of[3]).otherwise(of[2])


def _cuts(length: int) -> Column:
    places = range(1, length + 1)
    return F.array(*[F.struct(F.lit(k).alias("k"), _packed(*places[:k]).alias("left"), _packed(*places[k:]).alias("right"))
                     for k in places[:-1]])


def _parts(length: int) -> Column:
    parts = [_packed(*range(i, i + size)) for size in range(2, length) for i in range(1, length - size + 2)]
    return F.array(*parts) if parts else F.array().cast("array<struct<hi:bigint,lo:bigint>>")


def scored(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """hi, lo, a and the lowest-scoring cut (l, r, score) of every phrase."""
    words = vocabulary.select(F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("long").alias("lo"), F.col("n").alias("a"))
    counts = phrases.select("hi", "lo", "a").unionByName(words)
    cuts = phrases.select("hi", "lo", "a", F.inline(_by_length({m: _cuts(m) for m in (2, 3, 4)})))
    for side, name in (("left", "l"), ("right", "r")):
        known = counts.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("a").alias(name))
        cuts = cuts.join(known, (F.col(f"{side}.hi") == F.col("_hi")) & (F.col(f"{side}.lo") == F.col("_lo"))).drop("_hi", "_lo")
    score = F.expr("CAST((CAST(a AS DECIMAL(20, 0)) * 2000000) DIV (CAST(l AS DECIMAL(20, 0)) + r) AS BIGINT)")
    return cuts.groupBy("hi", "lo", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select(
        "hi", "lo", "a", "cut.l", "cut.r", "cut.score")


def not_absorbed(phrases: DataFrame) -> DataFrame:
    """Keys of the phrases that no longer one holds at least four times out of five."""
    inner = phrases.filter(_word(3) != 0).select("a", F.inline(_by_length({m: _parts(m) for m in (2, 3, 4)})))
    longest = inner.groupBy("hi", "lo").agg(F.max("a").alias("longer"))
    kept = F.expr(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {ABSORBED_PERCENT}")
    return phrases.join(longest, ["hi", "lo"], "left").filter(kept).select("hi", "lo")


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN_COUNT, entries: int = FILTER_ENTRIES,
                 id_bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` phrases by their weakest cut.

    Reads text and lang of every row of `docs` and no other column, whatever its name or type; repeated rows and rows without an id
    count. A null text is empty, a null lang is `und`. Ties are broken by count, then by the bytes of the phrase. A
    text is held whole by one task, whatever its length, so is a word. Without frequent phrases, as on an empty
    table, there are no rows.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    blocks = saved(rows.mapInArrow(
        in_tasks(blocks_of, BLOCK_BYTES, HELD_BYTES), "block long, lang string, words array<string>, counts array<long>, numbers binary, n long"), "blocks")
    vocabulary = saved(word_ids(blocks, least), "vocabulary")
    phrases = saved(frequent_phrases(blocks, vocabulary, least, entries, id_bits), "phrases")

    langs = vocabulary.select(F.col("id").alias("_id"), "lang")
    ranked = scored(phrases, vocabulary).join(not_absorbed(phrases), ["hi", "lo"]).withColumn("_id", _word(1)).join(langs, "_id").drop("_id")
    order = [F.col("score").desc(), F.col("a").desc()]
    near = ranked.withColumn("_part", F.pmod(F.xxhash64("hi", "lo"), F.lit(RANKED_PARTS)))
    for by in (["lang", "_part"], ["lang"]):
        near = near.withColumn("_rank", F.rank().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= top)
    for place in (1, 2, 3, 4):
        words = vocabulary.select(F.col("id").alias(f"_id{place}"), F.col("word").alias(f"_word{place}"))
        near = near.withColumn(f"_id{place}", _word(place)).join(words, f"_id{place}", "left" if place > 2 else "inner")
    named = near.withColumn("phrase", F.concat_ws(" ", *[f"_word{p}" for p in (1, 2, 3, 4)]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    return named.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM worded, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE len(w) >= m),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 30),
cuts AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail
  FROM candidates AS c, (VALUES (1), (2), (3)) AS ks(k) WHERE k < m),
scores AS (SELECT cuts.lang, cuts.m, cuts.phrase, a, k, h.f AS l, t.f AS r, (2000000::HUGEINT * a // (h.f + t.f))::BIGINT AS score
  FROM cuts JOIN counts AS h ON h.lang = cuts.lang AND h.phrase = head AND h.m = k
  JOIN counts AS t ON t.lang = cuts.lang AND t.phrase = tail AND t.m = cuts.m - k),
weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM candidates, (VALUES (2), (3)) AS ss(s), (VALUES (1), (2), (3)) AS starts(i) WHERE s < m AND i + s - 1 <= m),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT weakest.* FROM weakest LEFT JOIN longest USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000"""
