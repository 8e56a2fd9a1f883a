"""Byte-pair encoding and decoding by forced boundaries.

Two neighbouring bytes that occur inside no token of the vocabulary can never be merged, so the place
between them is a certain cut. Whole texts are cut before blanks in this way, the fragments are encoded
one by one (each distinct fragment once while it stays in the memory of a worker), and the ids are
joined. Within a fragment the pre-tokenizer's words are cut at forced boundaries again before any merge.
"""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ledgerloom.llm.decontam import BACK_STEP, GRAM_STEP, SPREAD, mixed
from ledgerloom.llm.shared import chunked, in_tasks, list_array, text_buffer

# The pattern of byte-level pre-tokenizers of this family.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

CACHED_PIECES = 250_000
CACHED_FRAGMENTS = 50_000
NAIVE_BYTES = 48
DECODED_ROWS = 256
ENCODED_BYTES = 1 << 19


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in shown}
    rest = (b for b in range(256) if b not in set(shown))
    return letters | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and forced boundaries of one tokenizer file (byte-level BPE, no normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or kind["type"] != "ByteLevel" \
                or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        letters = byte_letters()
        ids = {bytes(letters[c] for c in token): number for token, number in spec["model"]["vocab"].items()
               if all(c in letters for c in token)}
        self.special = {}
        for token in spec["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
                raise ValueError("added tokens that look at their surroundings are not supported")
            self.special[token["content"]] = token["id"]
        self.specials = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")"
        ) if self.special else None
        self.tokens = {number: token for token, number in ids.items()} | {
            number: token.encode() for token, number in self.special.items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (bytes(letters[c] for c in part) for part in (left, right))
            self.merges[ids[a], ids[b]] = rank, ids[a + b]
        #: inside[a, b]: bytes a and b stand next to each other in some token, special ones too
        self.inside = np.zeros((256, 256), bool)
        for token in [*ids, *(token.encode() for token in self.special)]:
            both = np.frombuffer(token, np.uint8)
            self.inside[both[:-1], both[1:]] = True
        self.size = max(self.tokens) + 1

    def fragments(self, word: bytes) -> Iterable[bytes]:
        """The word, cut at all forced boundaries."""
        start, inside = 0, self.inside
        for place in range(1, len(word)):
            if not inside[word[place - 1], word[place]]:
                yield word[start:place]
                start = place
        yield word[start:]

    def merged(self, fragment: bytes) -> list[int]:
        """Apply the merges, lowest rank first and leftmost first among equals."""
        ids = [self.byte_ids[b] for b in fragment]
        if len(ids) > NAIVE_BYTES:
            return self._merged_long(ids)
        merges = self.merges
        while len(ids) > 1:
            best, at = None, -1
            for place, pair in enumerate(zip(ids, ids[1:])):
                found = merges.get(pair)
                if found is not None and (best is None or found < best):
                    best, at = found, place
            if best is None:
                break
            ids[at:at + 2] = [best[1]]
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same merges from a queue, so that long fragments cost n log n."""
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        queue = [(*self.merges[pair], place, *pair) for place, pair in enumerate(zip(ids, ids[1:]))
                 if pair in self.merges]
        heapq.heapify(queue)
        while queue:
            _, made, place, left, right = heapq.heappop(queue)
            follower = after[place]
            if ids[place] != left or follower < 0 or ids[follower] != right:
                continue
            ids[place], ids[follower] = made, -1
            after[place] = after[follower]
            if after[follower] >= 0:
                before[after[follower]] = place
            for start in (before[place], place):
                stop = after[start] if start >= 0 else -1
                if stop >= 0 and (ids[start], ids[stop]) in self.merges:
                    heapq.heappush(queue, (*self.merges[ids[start], ids[stop]], start, ids[start], ids[stop]))
        return [number for number in ids if number >= 0]

    def encoded(self, text: str, words: dict[bytes, list[int]]) -> list[int]:
        """Ids of a text; `words` remembers fragments between calls."""
        found: list[int] = []
        parts = self.specials.split(text) if self.specials else [text]
        for part in parts:
            if part in self.special:
                found.append(self.special[part])
                continue
            for word in WORDS.findall(part):
                for fragment in self.fragments(word.encode()):
                    known = words.get(fragment)
                    if known is None:
                        if len(words) >= CACHED_FRAGMENTS:
                            words.clear()
                        known = words[fragment] = self.merged(fragment)
                    found += known
        return found


def _byte_classes() -> np.ndarray:
    """1: ASCII letter or digit, 2: other printable ASCII, 4: blank or line break, 0: anything else."""
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = 2
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
        kinds[low:high + 1] = 1
    kinds[[0x0A, 0x20]] = 4
    return kinds


KINDS = _byte_classes()


def certain_cuts(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Offsets at which a text can be cut without changing its ids.

    The bytes on both sides stand next to each other in no token, and the pre-tokenizer splits there as
    well, whatever surrounds them: before a blank or line break that follows a printable character,
    after a single line break between two of them, and between a letter or digit and a punctuation mark.
    Printable is seen on ASCII bytes and on the letters led by 0xC3; other places are left uncut.
    """
    kinds = KINDS[data]
    tail = (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[:-1] == 0xC3)
    tail &= (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter = kinds == 1
    letter[1:] |= tail
    seen = letter | (kinds == 2)
    space = kinds == 4
    cut = (seen[:-1] & space[1:]) | (letter[:-1] & (kinds[1:] == 2))
    after_break = (data[:-1] == 0x0A) & ((kinds[1:] & 3 > 0) | (data[1:] == 0xC3))
    after_break[0] = False
    after_break[1:] &= seen[:-2]
    places = np.flatnonzero(cut | after_break) + 1
    return places[~inside[data[places - 1], data[places]]]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `sizes` many, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


#: A word's first so many bytes.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def same_pieces(data: np.ndarray, starts: np.ndarray, other: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether all pieces of `data` are those of `other`, compared by words of eight bytes.

    Both arrays have seven bytes or more behind the last piece. What pieces have beyond 64 bytes is compared byte by byte.
    """
    left, right = (np.ndarray((len(a) - 7,), "<u8", a, 0, (1,)) for a in (data, other))
    for _ in range(8):
        if ((left[starts] ^ right[places]) & FIRST_BYTES[np.minimum(sizes, 8)]).any():
            return False
        more = np.flatnonzero(sizes > 8)
        starts, places, sizes = starts[more] + 8, places[more] + 8, sizes[more] - 8
        if not len(sizes):
            return True
    return bool((data[ranges(starts, sizes)] == other[ranges(places, sizes)]).all())


class Grown:
    """An array that doubles as it fills; only the first `size` values count, and seven or more follow them."""

    def __init__(self, kind: type):
        self.values, self.size = np.zeros(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need + 7 > len(self.values):
            wider = np.zeros(max(need + 7, 2 * len(self.values)), self.values.dtype)
            wider[: self.size] = self.values[: self.size]
            self.values = wider
        self.values[self.size: need] = more
        self.size = need


class PieceTable:
    """Ids of known pieces by the hash of their bytes; all lookups are numpy gathers.

    Slots are probed linearly. `used` is how many calls have asked for an entry, halved whenever the table is full; then
    the half asked for least makes room, so pieces met once, however late, do not drive out those met again and again.
    """

    def __init__(self, entries: int):
        self.limit = entries
        self.slot_bits = max(4, (2 * entries - 1).bit_length())
        self._reset()

    def _reset(self) -> None:
        self.slots = np.full(1 << self.slot_bits, -1, np.int32)
        self.count = 0
        self._hashes, self._used = Grown(np.uint64), Grown(np.int32)
        self._ids, self._id_starts, self._id_sizes = Grown(np.uint32), Grown(np.int64), Grown(np.int64)
        self._bytes, self._byte_starts, self._byte_sizes = Grown(np.uint8), Grown(np.int64), Grown(np.int64)
        self._bind()

    def _bind(self) -> None:
        self.hashes, self.used = self._hashes.values, self._used.values
        self.ids, self.id_starts, self.id_sizes = self._ids.values, self._id_starts.values, self._id_sizes.values
        self.bytes, self.byte_starts, self.byte_sizes = self._bytes.values, self._byte_starts.values, self._byte_sizes.values

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of every hash, or -1; entries found count as used once."""
        found = np.full(len(hashes), -1, np.int64)
        if not self.count:
            return found
        asked, slot = np.arange(len(hashes)), self._home(hashes)
        while len(asked):
            entry = self.slots[slot]
            taken = entry >= 0
            right = taken & (self.hashes[entry] == hashes[asked])
            found[asked[right]] = entry[right]
            onward = taken & ~right
            asked, slot = asked[onward], (slot[onward] + 1) & (len(self.slots) - 1)
        self.used[found[found >= 0]] += 1
        return found

    def _place(self, entries: np.ndarray) -> None:
        slot = self._home(self.hashes[entries])
        while len(entries):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            mine = free[first]
            self.slots[slot[mine]] = entries[mine]
            left = np.ones(len(entries), bool)
            left[mine] = False
            entries, slot = entries[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _append(self, hashes, used, ids, id_sizes, data, byte_sizes) -> None:
        first = self.count
        self._id_starts.extend(self._ids.size + np.cumsum(id_sizes) - id_sizes)
        self._byte_starts.extend(self._bytes.size + np.cumsum(byte_sizes) - byte_sizes)
        for grown, more in ((self._hashes, hashes), (self._used, used), (self._ids, ids), (self._id_sizes, id_sizes),
                            (self._bytes, data), (self._byte_sizes, byte_sizes)):
            grown.extend(more)
        self.count += len(hashes)
        self._bind()
        self._place(np.arange(first, self.count))

    def add(self, hashes: np.ndarray, pieces: list[bytes], ids: list[bytes]) -> bool:
        """Add pieces that are not in the table as its last entries; whether the entries before are where they were."""
        full = bool(self.count + len(hashes) > self.limit and self.count)
        if full:
            used = self.used[: self.count]
            stay = np.flatnonzero(used > np.median(used))
            kept = (self.hashes[stay], self.used[stay] >> 1, self.ids[ranges(self.id_starts[stay], self.id_sizes[stay])],
                    self.id_sizes[stay], self.bytes[ranges(self.byte_starts[stay], self.byte_sizes[stay])], self.byte_sizes[stay])
            self._reset()
            self._append(*kept)
        while 2 * (self.count + len(hashes)) > len(self.slots):
            self.slot_bits += 1
            self.slots = np.full(1 << self.slot_bits, -1, np.int32)
            self._place(np.arange(self.count))
        self._append(hashes, np.ones(len(hashes), np.int32), np.frombuffer(b"".join(ids), np.uint32),
                     np.fromiter(map(len, ids), np.int64, len(ids)) >> 2, np.frombuffer(b"".join(pieces), np.uint8),
                     np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return not full


class Encoder:
    """Encodes chunks of texts piece by piece; `fill` turns unseen pieces into little-endian id bytes."""

    def __init__(self, inside: np.ndarray, fill: Callable[[list[bytes]], Iterable[bytes]], entries: int = CACHED_PIECES):
        self.inside, self.fill, self.known = inside, fill, PieceTable(entries)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of each text's ids."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        mark = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            mark[certain_cuts(data, self.inside)] = True
        mark[offsets] = True
        mark[-1] = True
        bounds = np.flatnonzero(mark)
        starts, stops, sizes = bounds[:-1], bounds[1:], np.diff(bounds)
        hashes = piece_hashes(data, starts, stops)
        entries = self.known.find(hashes)
        unseen = np.flatnonzero(entries < 0)
        if len(unseen):
            raw = data.tobytes()
            fresh, first, which = np.unique(hashes[unseen], return_index=True, return_inverse=True)
            first = unseen[first]
            pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())]
            if self.known.add(fresh, pieces, list(self.fill(pieces))):
                entries[unseen] = self.known.count - len(fresh) + which
            else:
                entries = self.known.find(hashes)
        known = self.known
        if (entries < 0).any() or not (known.byte_sizes[entries] == sizes).all() \
                or not same_pieces(np.concatenate([data, np.zeros(7, np.uint8)]), starts, known.bytes, known.byte_starts[entries], sizes):
            # A chunk with more pieces than the table holds, or two pieces with one hash: without the table.
            raw = data.tobytes()
            done = list(self.fill([raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())]))
            counts, ids = np.fromiter(map(len, done), np.int64, len(done)) >> 2, np.frombuffer(b"".join(done), np.uint32)
        else:
            counts = known.id_sizes[entries]
            ids = known.ids[ranges(known.id_starts[entries], counts)]
        totals = np.concatenate([[0], np.cumsum(counts)])
        return ids, totals[np.searchsorted(bounds, offsets)]


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash step and of its inverse, 2**bits of each."""
    def powers(step: np.uint64) -> np.ndarray:
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full((1 << bits) - 1, step, np.uint64))])

    return powers(GRAM_STEP), powers(BACK_STEP)


def piece_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every piece, from one running sum over the chunk."""
    ahead, back = _powers(max(19, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(SPREAD[data] * ahead[: len(data)], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def _encoder(path: str) -> Encoder:
    """One per worker process, so that pieces stay known from task to task."""
    vocab, words = vocabulary(path), {}
    return Encoder(vocab.inside, lambda pieces: (
        np.array(vocab.encoded(piece.decode(), words), np.uint32).tobytes() for piece in pieces))


class Decoder:
    """Joins token bytes by numpy: each id's bytes are copied from one long table."""

    def __init__(self, vocab: Vocabulary):
        tokens = [vocab.tokens.get(number, b"") for number in range(vocab.size)]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.table = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the id lists; bytes that are no UTF-8 become U+FFFD, unknown ids become nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.sizes)), ids, -1)
        sizes = np.where(ids >= 0, self.sizes[ids], 0)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        within = np.arange(total) - np.repeat(ends - sizes, sizes)
        raw = self.table[np.repeat(self.starts[ids], sizes) + within].tobytes()
        places = np.concatenate([[0], ends])[offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(places, places[1:])]


@cache
def _decoder(path: str) -> Decoder:
    return Decoder(vocabulary(path))


def _encode_batches(path: str, text: str, ids: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    for piece in chunked(batches, text, ENCODED_BYTES):
        values, bounds = encoder.encode(*text_buffer(piece.column(text)))
        yield pa.RecordBatch.from_arrays([*piece.columns, list_array(values.astype(np.int32), bounds)],
                                         [*piece.schema.names, ids])


def _decode_batches(path: str, ids: str, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decoder = _decoder(path)
    for batch in batches:
        for start in range(0, batch.num_rows, DECODED_ROWS):
            part = batch.slice(start, DECODED_ROWS)
            lists = part.column(ids).fill_null([])
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.asarray(lists.offsets).astype(np.int64)
            texts = pa.array(decoder.decode(values, bounds - bounds[0]), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, text])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the array of token ids of a text column. No special tokens are added.

    The string of a special token inside a text becomes that token, as with the tokenizers library's
    defaults. Null and empty texts have an empty array. Texts are encoded whole, whatever their length.
    A column already named like `ids` is replaced.
    """
    picked = docs.drop(ids)
    return picked.mapInArrow(in_tasks(_encode_batches, path, text, ids), StructType([*picked.schema.fields]).add(ids, ArrayType(IntegerType())))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of an array of token ids; special tokens are kept. Null decodes to the empty text."""
    picked = docs.drop(text)
    return picked.mapInArrow(in_tasks(_decode_batches, path, ids, text), StructType([*picked.schema.fields]).add(text, StringType()))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.concat_ws(",", ids.cast("array<string>"))


def _round_trips(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, decoder = _encoder(path), _decoder(path)
    for piece in chunked(batches, "text", ENCODED_BYTES):
        values, bounds = encoder.encode(*text_buffer(piece.column("text")))
        texts = pa.array(decoder.decode(values.astype(np.int64), bounds), pa.string())
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), list_array(values.astype(np.int32), bounds), texts], ["doc_id", "ids", "decoded"])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; return digests of the ids and of the decoded text by document.

    Both steps are one visit to Python, as `encode` and `decode` would do one after the other.
    """
    schema = StructType([docs.schema["doc_id"]]).add("ids", ArrayType(IntegerType())).add("decoded", StringType())
    return docs.select("doc_id", "text").mapInArrow(in_tasks(_round_trips, path), schema).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def default_path() -> str:
    """The public 50k byte-level vocabulary of the installed package."""
    if "/opt" not in sys.path:
        sys.path.append("/opt")
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
