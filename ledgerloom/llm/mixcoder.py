"""A range coder for token ids driven by mixed order-0, order-1 and order-2 predictions.

A block of ids is laid out as lanes of equal length that are coded side by side: step t codes the t-th
id of every lane with numpy, and what the lanes have shown is then learned by one model they share.
Every block starts from an empty model and carries checksums, so blocks can be read independently.

Prediction. A table by the previous id and one by a hash of the previous two hold the id seen last and
how often it was right in a row. The mass given to the two guesses is learned per pair of such counts;
the rest goes to adaptive order-0 frequencies. The three are added into one distribution.

Fewer lanes learn more before they predict, and cost more steps. LANES and BLOCK_IDS were chosen by both (README).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 3 << 10
LANE_IDS = 128
BLOCK_IDS = 1 << 22
TOTAL_BITS = 26
BASE_BITS = 20
PAIR_BITS = 21
SURE = 15
HEADER = struct.Struct("<4sIIIIII")
MAGIC = b"MXB2"
WORDS_AT_END = 2
LOW48 = (1 << 48) - 1
RANGE_FLOOR = 1 << 32
PAIR_A, PAIR_B, PAIR_SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(32 - PAIR_BITS)
STRIPE = 64
BINS = (SURE + 1) ** 2
# By which guesses are right (1: by two ids, 2: by one, 3: both): the mark at which the id's interval starts, and the outcome.
MARK = np.array([3, 0, 1, 0])
OUTCOME = np.array([0, 1, 2, 1]) * BINS
# What is added to an entry by `sure`, and 16 more if its guess was right; a guess that was wrong at 1 or less is replaced.
CHANGE = np.array([(sure >> 1) - sure for sure in range(SURE + 1)] + [int(sure < SURE) for sure in range(SURE + 1)], np.int32)


class Model:
    """What the lanes of a block have shown so far; the same in the coder and the decoder.

    A table entry packs a guess and how often it was right in a row (`sure`, four bits). Both tables are one array, by two
    ids first, and what is looked up in them has two rows. `marks` are the bounds of the intervals of every lane: 0, the
    end of the guess by two ids, the end of the guess by one, and start and end of the id if it is not guessed.
    """

    def __init__(self, alphabet: int, lanes: int):
        self.alphabet, self.lanes = alphabet, lanes
        self.counts = np.zeros(alphabet, np.int64)
        self.waiting: list[np.ndarray] = []
        self.table = np.zeros((1 << PAIR_BITS) + alphabet, np.int32)
        self.outcomes = np.repeat([[0.6], [0.2], [0.2]], BINS, axis=1)
        self.last = np.zeros(lanes, np.uint32)
        self.previous = np.zeros(lanes, np.uint32)
        self.place = np.zeros((2, lanes), np.int64)
        self.marks = np.zeros((5, lanes), np.int64)
        self.flat_marks = self.marks.reshape(-1)
        self.every = np.arange(lanes)
        self.mark_places = MARK * lanes
        self.step, self.rebuild_at = 0, 0

    def _rebuild(self) -> None:
        if self.waiting:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=self.alphabet)
            self.waiting.clear()
        room = (1 << BASE_BITS) - self.alphabet
        seen = int(self.counts.sum())
        share = self.counts * room // seen if seen else np.zeros(self.alphabet, np.int64)
        share += 1
        share[int(np.argmax(share))] += (1 << BASE_BITS) - int(share.sum())
        self.base = np.concatenate([[0], np.cumsum(share)])
        self.share, self.inverse = share, None
        self.rebuild_at = self.step * 2 if 0 < self.step < 64 else self.step + (64 if self.step else 1)

    def predict(self) -> None:
        """Guesses and masses for the next id of every lane.

        The learned masses of the two guesses come first in the total, then the order-0 frequencies
        scaled to the rest. An id that is guessed is coded by its guess.
        """
        if self.step == self.rebuild_at:
            self._rebuild()
        self.place[0] = ((self.previous * PAIR_A) ^ (self.last * PAIR_B)) >> PAIR_SHIFT
        np.add(self.last, 1 << PAIR_BITS, out=self.place[1])
        self.entry = self.table.take(self.place)
        self.guess, self.sure = self.entry >> 4, self.entry & SURE
        self.bin = ((self.sure[0] << 4) | self.sure[1]).astype(np.int64)
        none, two, one = self.outcomes
        total = none + two + one
        scale = (1 << TOTAL_BITS) - (1 << BASE_BITS)
        mass_two, mass_one = (two / total * scale).astype(np.int64), (one / total * scale).astype(np.int64)
        np.take(mass_two, self.bin, out=self.marks[1], mode="clip")
        np.take(mass_two + mass_one, self.bin, out=self.marks[2], mode="clip")
        self.rest = (1 << TOTAL_BITS) - self.marks[2]

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the ids within the total."""
        self.ids, marks = ids.astype(np.int64), self.marks
        self.right = (self.guess == ids).view(np.uint8)
        self.kind = self.right[0] | (self.right[1] << 1)
        np.multiply(self.rest, self.base.take(self.ids), out=marks[3])
        np.multiply(self.rest, self.base.take(self.ids + 1), out=marks[4])
        marks[3:] >>= BASE_BITS
        marks[3:] += marks[2]
        at = self.mark_places.take(self.kind) + self.every
        start = self.flat_marks.take(at)
        at += self.lanes
        return start, self.flat_marks.take(at) - start

    def find(self, place: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the places. The quotient is exact: it has under 53 bits."""
        if self.inverse is None:  # only the decoder asks
            self.inverse = np.repeat(np.arange(self.alphabet, dtype=np.int32), self.share)
        guessed = self.marks[2]
        base = ((np.maximum(place - guessed, 0) + 1) << BASE_BITS) - 1
        found = self.inverse.take((base / self.rest).astype(np.int64))
        found = np.where(place < guessed, self.guess[1], found)
        return np.where(place < self.marks[1], self.guess[0], found)

    def learn(self, ids: np.ndarray) -> None:
        """Take in the ids of one step; `interval` has compared them with the guesses."""
        self.waiting.append(ids)
        self.outcomes += np.bincount(OUTCOME.take(self.kind) + self.bin, minlength=3 * BINS).reshape(3, BINS)
        case = self.sure + (self.right << 4)
        self.table[self.place] = np.where(case < 2, (ids << 4) | 1, self.entry + CHANGE.take(case))
        self.previous, self.last = self.last, ids.view(np.uint32)
        self.step += 1


def lanes_for(n: int) -> int:
    return max(1, min(LANES, n // LANE_IDS))


def turned(rows: np.ndarray) -> np.ndarray:
    """The transpose as an array of its own, copied in stripes that stay in the cache."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for low in range(0, len(rows), STRIPE):
        out[:, low: low + STRIPE] = rows[low: low + STRIPE].T
    return out


def carried(flat: np.ndarray) -> None:
    """Take what is over 16 bits in a word to the word before it."""
    over = np.flatnonzero(flat > 0xFFFF)
    while len(over):
        flat[over] &= 0xFFFF
        over -= 1
        flat[over] += 1
        over = over[flat[over] > 0xFFFF]


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """Header and payload of one block. `alphabet` is more than every id, at most 2**19."""
    n = len(ids)
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    laid = np.zeros(lanes * steps, np.int32)
    laid[:n] = ids
    laid = turned(laid.reshape(lanes, steps))
    model = Model(alphabet, lanes)
    room = 2 * steps + 3
    words = np.zeros((lanes, room), np.uint32)
    flat = words.reshape(-1)
    every = np.arange(lanes)
    at = every * room  # where in `flat` the next word of each lane goes
    low = np.zeros(lanes, np.int64)
    width = np.full(lanes, LOW48, np.int64)
    for row in laid:
        model.predict()
        start, size = model.interval(row)
        unit = width >> TOTAL_BITS
        low += unit * start
        width = unit * size
        over = np.flatnonzero(low > LOW48)
        if len(over):
            flat[at[over] - 1] += 1
            low[over] &= LOW48
        short = (width < RANGE_FLOOR).astype(np.int64)
        flat[at] = low >> 32  # lanes that are not short write too; their next word replaces it
        at += short
        short <<= 4
        low = (low << short) & LOW48
        width <<= short
        short = np.flatnonzero(width < RANGE_FLOOR)
        while len(short):
            flat[at[short]] = low[short] >> 32
            at[short] += 1
            low[short] = (low[short] << 16) & LOW48
            width[short] <<= 16
            short = short[width[short] < RANGE_FLOOR]
        model.learn(row)
    used = at - every * room
    low = (low | 0xFFFF) + 1  # the first number in the interval that two words tell, whatever follows them
    over = np.flatnonzero(low > LOW48)
    words[over, used[over] - 1] += 1
    low[over] &= LOW48
    for _ in range(WORDS_AT_END):
        words[every, used] = low >> 32
        used += 1
        low = (low << 16) & LOW48
    carried(flat)
    taken = np.arange(room) < used[:, None]
    kind = "<u2" if int(used.max()) < 1 << 16 else "<u4"
    payload = struct.pack("<B", int(kind[2])) + used.astype(kind).tobytes() + words[taken].astype("<u2").tobytes()
    return HEADER.pack(MAGIC, n, lanes, alphabet, len(payload), zlib.crc32(payload),
                       zlib.crc32(ids.astype("<u4").tobytes())) + payload


def decode_block(header: bytes, payload: bytes) -> np.ndarray:
    """Ids of one block; raises ValueError where a checksum fails."""
    magic, n, lanes, alphabet, size, check, ids_check = HEADER.unpack(header)
    if magic != MAGIC or size != len(payload) or zlib.crc32(payload) != check:
        raise ValueError("damaged block")
    steps = -(-n // lanes)
    used = np.frombuffer(payload, f"<u{payload[0]}", lanes, 1).astype(np.int64)
    stream = np.frombuffer(payload, "<u2", offset=1 + payload[0] * lanes)
    stream = np.concatenate([stream, np.zeros(4, np.uint16)])
    place = np.cumsum(used) - used
    first = [stream[place + more].astype(np.int64) for more in range(3)]
    code = (first[0] << 32) | (first[1] << 16) | first[2]
    place = place + 3
    width = np.full(lanes, LOW48, np.int64)
    model = Model(alphabet, lanes)
    rows = np.empty((steps, lanes), np.int32)
    most = (1 << TOTAL_BITS) - 1
    for row in rows:
        model.predict()
        unit = width >> TOTAL_BITS
        found = model.find(np.minimum((code / unit).astype(np.int64), most))
        start, size = model.interval(found)
        code -= unit * start
        width = unit * size
        short = (width < RANGE_FLOOR).astype(np.int64)
        word = stream.take(place) * short
        place += short
        short <<= 4
        code = (code << short) | word
        width <<= short
        short = np.flatnonzero(width < RANGE_FLOOR)
        while len(short):
            code[short] = (code[short] << 16) | stream[place[short]]
            place[short] += 1
            width[short] <<= 16
            short = short[width[short] < RANGE_FLOOR]
        row[:] = found
        model.learn(found)
    ids = turned(rows).reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_check:
        raise ValueError("a block decodes to other ids than were written")
    return ids
