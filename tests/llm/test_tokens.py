import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import counted, documents, empty_like
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, mixcoder, tokenfiles
from ledgerloom.llm.shared import text_buffer, work_folder

PATH = bpe.default_path()
ODD = ["", " ", "  a", "a  b", "a \n b", "a\n\nb\nc", "hi<|endoftext|> x<|endoftext|>", "à la à", "x  y", "it's 're 'tx", "é é  é\té",
       "12 34 5a6", "a" * 400, "ab" * 300 + " \x00z", "<|endoftext|", "×÷ a×b", "a,b.c;\n\"d\"", "　 日本 語", "!!! ??? ...\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_round_trip_equals_the_library(spark, library):
    docs = documents(spark).select("doc_id", "text", "key")
    docs = docs.unionByName(spark.createDataFrame([(i, t, 0) for i, t in enumerate(ODD)], "doc_id long, text string, key int"))

    def row(r):
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        return (r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(text.encode()).hexdigest())

    assert counted(bpe.round_trip(docs, PATH).collect()) == counted(map(row, docs.collect()))
    assert bpe.round_trip(empty_like(docs), PATH).count() == 0


def test_encode_keeps_other_columns(spark):
    docs = documents(spark).withColumnRenamed("key", "ids")
    assert bpe.encode(docs, PATH).columns == [c for c in docs.columns if c != "ids"] + ["ids"]


def test_no_token_holds_a_forced_boundary():
    vocab = bpe.vocabulary(PATH)
    assert all(vocab.inside[a, b] for token in list(vocab.tokens.values())[::50] for a, b in zip(token, token[1:]))
    assert b"".join(vocab.fragments(b"word, and more")) == b"word, and more"


def test_long_fragments_merge_alike():
    vocab = bpe.vocabulary(PATH)
    for text in (b"a" * 47, b"abcabcab" * 5, b"ingtheer" * 5):
        assert vocab._merged_long([vocab.byte_ids[b] for b in text]) == vocab.merged(text)


def test_bytes_that_are_no_text_decode_like_the_library(library):
    ids = [200, 201, 220, 50256, 130, 255]
    assert bpe._decoder(PATH).decode(np.array(ids), np.array([0, len(ids)])) == [library.decode(ids, skip_special_tokens=False)]


def test_both_encoders_agree():
    data, offsets = text_buffer(pa.array(ODD + [None]))
    ours, theirs = bpe._encoder(PATH), tokenfiles._library_encoder(PATH)[0]
    for left, right in zip(ours.encode(data, offsets), theirs.encode(data, offsets)):
        assert left.tolist() == right.tolist()


@pytest.mark.parametrize("n", [1, 2, 127, 128, 1000, 40_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, 50_257, n), rng.zipf(1.4, n) % 50_257)
    block = mixcoder.encode_block(ids, 50_257)
    header, payload = block[:mixcoder.HEADER.size], block[mixcoder.HEADER.size:]
    assert mixcoder.decode_block(header, payload).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        mixcoder.decode_block(header, payload[:-1] + bytes([payload[-1] ^ 1]))


def test_predictions_shrink_repeats():
    ids = np.tile(np.arange(500) * 7 % 50_000, 80)
    assert len(mixcoder.encode_block(ids, 50_257)) < len(ids)


class PlainModel:
    """The model of the coder as its description says it, one table and one choice after the other."""

    def __init__(self, alphabet, lanes):
        self.alphabet, self.seen, self.step, self.rebuild_at = alphabet, [], 0, 0
        self.after_one, self.after_two = np.zeros(alphabet, np.int32), np.zeros(1 << mixcoder.PAIR_BITS, np.int32)
        self.outcomes = np.zeros((256, 4)) + [0.6, 0.2, 0.2, 0.0]
        self.last, self.previous = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)

    def interval(self, ids):
        if self.step == self.rebuild_at:
            counts = np.bincount(np.concatenate(self.seen or [np.zeros(0, np.int32)]), minlength=self.alphabet)
            share = counts * ((1 << mixcoder.BASE_BITS) - self.alphabet) // max(1, int(counts.sum())) + 1
            share[int(np.argmax(share))] += (1 << mixcoder.BASE_BITS) - int(share.sum())
            self.base = np.concatenate([[0], np.cumsum(share)])
            self.rebuild_at = self.step * 2 if 0 < self.step < 64 else self.step + (64 if self.step else 1)
        first, second = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
        self.pair = ((self.previous.view(np.uint32) * first) ^ (self.last.view(np.uint32) * second)) >> np.uint32(32 - mixcoder.PAIR_BITS)
        self.one, self.two = self.after_one[self.last], self.after_two[self.pair]
        self.bin = ((self.two & 15) << 4) | (self.one & 15)
        share = self.outcomes / self.outcomes.sum(axis=1, keepdims=True)
        mass = (share[:, 1:3] * ((1 << mixcoder.TOTAL_BITS) - (1 << mixcoder.BASE_BITS))).astype(np.int64)
        two, both = mass[self.bin, 0], mass[self.bin].sum(axis=1)
        rest = (1 << mixcoder.TOTAL_BITS) - both
        start, stop = ((rest * self.base[ids + more] >> mixcoder.BASE_BITS) + both for more in (0, 1))
        self.right_two, self.right_one = ids == self.two >> 4, ids == self.one >> 4
        start = np.where(self.right_two, 0, np.where(self.right_one, two, start))
        return start, np.where(self.right_two, two, np.where(self.right_one, both, stop)) - start

    def learn(self, ids):
        self.seen.append(ids)
        np.add.at(self.outcomes, (self.bin, np.where(self.right_two, 1, np.where(self.right_one, 2, 0))), 1)
        for table, place, entry, right in ((self.after_two, self.pair, self.two, self.right_two), (self.after_one, self.last, self.one, self.right_one)):
            sure = entry & 15
            wrong = np.where(sure > 1, entry - sure + (sure >> 1), (ids << 4) | 1)
            table[place] = np.where(right, entry + (sure < 15), wrong)
        self.previous, self.last, self.step = self.last, ids, self.step + 1


def test_predictions_are_those_of_the_plain_model():
    rng, lanes, alphabet = np.random.default_rng(5), 200, 3000
    ids = np.where(rng.random((150, lanes)) < 0.4, np.arange(150)[:, None] % 7, rng.zipf(1.3, (150, lanes)) % alphabet).astype(np.int32)
    model, plain, kinds = mixcoder.Model(alphabet, lanes), PlainModel(alphabet, lanes), set()
    for row in ids:
        model.predict()
        start, size = model.interval(row)
        wanted = plain.interval(row)
        assert start.tolist() == wanted[0].tolist() and size.tolist() == wanted[1].tolist()
        assert (size > 0).all() and model.find(start).tolist() == model.find(start + size - 1).tolist() == row.tolist()
        kinds |= set(zip(plain.right_two.tolist(), plain.right_one.tolist()))
        model.learn(row)
        plain.learn(row)
    assert len(kinds) == 4


def test_both_contexts_are_looked_up_at_once(monkeypatch):
    """The coder's time is that of its passes over the lanes: one lookup for both tables, and no lane by lane selection."""
    made = []

    class Table(np.ndarray):
        def take(self, *args, **kwargs):
            made.append("take")
            return np.asarray(self).take(*args, **kwargs)

        def __setitem__(self, place, entries):
            made.append("set")
            np.asarray(self)[place] = entries

    class Counted(mixcoder.Model):
        def __init__(self, *args):
            super().__init__(*args)
            for name in ("table", "after_one", "after_two"):
                if hasattr(self, name):
                    setattr(self, name, getattr(self, name).view(Table))

    monkeypatch.setattr(mixcoder, "Model", Counted)
    ids = np.arange(64 * mixcoder.LANE_IDS, dtype=np.int32) % 500
    block = mixcoder.encode_block(ids, 500)
    assert made == ["take", "set"] * mixcoder.LANE_IDS
    assert mixcoder.decode_block(block[:mixcoder.HEADER.size], block[mixcoder.HEADER.size:]).tolist() == ids.tolist()


def test_the_coder_makes_nothing_that_only_the_decoder_asks_for(monkeypatch):
    made = []

    class Noted(mixcoder.Model):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(mixcoder, "Model", Noted)
    ids = np.arange(3 * mixcoder.LANE_IDS, dtype=np.int32) % 50
    block = mixcoder.encode_block(ids, 50)
    assert made[0].inverse is None
    assert mixcoder.decode_block(block[:mixcoder.HEADER.size], block[mixcoder.HEADER.size:]).tolist() == ids.tolist()
    assert made[1].inverse is not None


def test_carries_and_turned_lanes():
    rng = np.random.default_rng(8)
    words = rng.choice([0, 7, 0xFFFF, 0x10000], (40, 30)).astype(np.uint32)
    words[:, 0] = 0
    wanted = words.astype(np.int64)
    for at in range(29, 0, -1):
        wanted[:, at - 1] += wanted[:, at] >> 16
        wanted[:, at] &= 0xFFFF
    mixcoder.carried(words.reshape(-1))
    assert words.tolist() == wanted.tolist()
    for shape in ((1, 1), (1, 300), (200, 3), (130, 64)):
        rows = rng.integers(0, 99, shape).astype(np.int32)
        made = mixcoder.turned(rows)
        assert made.tolist() == rows.T.tolist() and made.flags.c_contiguous


def test_contexts_gain_over_order_0(library):
    """The first full block of a table of prose: fewer bits than its order-0 entropy, by what the contexts tell."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").column("text").to_pylist()
    ids: list[int] = []
    for text in texts:
        ids += [*library.encode(text or "", add_special_tokens=False).ids, 0]
        if len(ids) >= mixcoder.BLOCK_IDS:
            break
    block = np.array(ids[:mixcoder.BLOCK_IDS], np.int32)
    share = np.bincount(block)
    share = share[share > 0] / len(block)
    order_0 = -(share * np.log2(share)).sum()
    bits = 8 * len(mixcoder.encode_block(block, 50_257)) / len(block)
    assert bits < 7.6 and bits < 0.93 * order_0


def test_files_hold_all_documents_in_order(spark, library):
    docs = documents(spark)
    got = tokenfiles.token_digests(docs, PATH).collect()

    def row(r):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        return r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())

    assert counted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == counted(map(row, docs.collect()))
    laid = sorted((r.start, r.n_tokens, r.doc_id is not None, r.doc_id or 0) for r in got)
    assert laid[0][0] == 0 and all(a[0] + a[1] == b[0] and a[2:] <= b[2:] for a, b in zip(laid, laid[1:]))
    assert tokenfiles.token_digests(empty_like(docs), PATH).count() == 0


def test_damage_is_noticed(spark):
    folder = work_folder(spark, "damage")
    manifest = tokenfiles.write_tokens(documents(spark).coalesce(1), PATH, folder)
    name = manifest.orderBy("n_bytes", ascending=False).first().file
    with open(f"{folder}/{name}", "r+b") as file:
        file.seek(200)
        byte = file.read(1)
        file.seek(200)
        file.write(bytes([byte[0] ^ 255]))
    with pytest.raises(Exception, match="damaged"):
        tokenfiles.read_tokens(manifest, folder).count()


def test_a_small_table_of_pieces_gives_the_same_ids():
    """Pieces are forgotten and learned again, also where one chunk has more than the table holds."""
    rng, vocab, words = random.Random(1), bpe.vocabulary(PATH), {}
    small = bpe.Encoder(vocab.inside, lambda pieces: (
        np.array(vocab.encoded(piece.decode(), words), np.uint32).tobytes() for piece in pieces), 50)
    made = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    for n in (5, 30, 200, 1, 0, 100):
        chunk = text_buffer(pa.array([" ".join(rng.choices(made, k=n)) for _ in range(3)]))
        for left, right in zip(small.encode(*chunk), bpe._encoder(PATH).encode(*chunk)):
            assert left.tolist() == right.tolist()


def test_pieces_met_again_and_again_stay_known():
    """A full table forgets what was asked for least, not what was asked for longest ago."""
    asked = []

    def fill(pieces):
        asked.extend(pieces)
        return [b"\x01\x00\x00\x00"] * len(pieces)

    encoder = bpe.Encoder(bpe.vocabulary(PATH).inside, fill, 40)

    def encode(words):
        encoder.encode(*text_buffer(pa.array([" ".join(words)])))

    often = [f"often{i}" for i in range(10)]
    for _ in range(6):
        encode(often)
    for i in range(200):
        encode([f"once{i}a", f"once{i}b", f"once{i}c"])
        if i % 8 == 7:
            encode(often)
    assert max(asked.count(b" " + word.encode()) for word in often[1:]) == 1


def test_a_chunk_is_looked_up_once(monkeypatch):
    """Pieces just learned are known by their place; only a table that has made room is asked again."""
    vocab, words, calls = bpe.vocabulary(PATH), {}, []
    encoder = bpe.Encoder(vocab.inside, lambda pieces: [
        np.array(vocab.encoded(piece.decode(), words), np.uint32).tobytes() for piece in pieces])
    chunks = [text_buffer(pa.array([text, None, text + " five"])) for text in ("one two one three", "three four one four", "one two")]
    wanted = [bpe._encoder(PATH).encode(*chunk) for chunk in chunks]
    find = bpe.PieceTable.find
    monkeypatch.setattr(bpe.PieceTable, "find", lambda self, hashes: (calls.append(len(hashes)), find(self, hashes))[1])
    for chunk, (ids, bounds) in zip(chunks, wanted):
        found = encoder.encode(*chunk)
        assert found[0].tolist() == ids.tolist() and found[1].tolist() == bounds.tolist()
    assert len(calls) == len(chunks)


def test_pieces_are_compared_to_their_last_byte():
    rng = np.random.default_rng(3)
    for size in (1, 7, 8, 9, 16, 63, 64, 65, 200):
        data = np.concatenate([rng.integers(0, 256, 3 * size).astype(np.uint8), np.zeros(7, np.uint8)])
        other = np.concatenate([data[size: 2 * size], rng.integers(0, 256, 9).astype(np.uint8)])
        starts, places, sizes = np.array([size]), np.array([0]), np.array([size])
        assert bpe.same_pieces(data, starts, other, places, sizes)
        for at in {0, size // 2, size - 1}:
            other[at] ^= 1
            assert not bpe.same_pieces(data, starts, other, places, sizes)
            other[at] ^= 1


def test_pieces_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "piece_hashes", lambda data, starts, stops: (stops - starts).astype(np.uint64))
    vocab = bpe.vocabulary(PATH)
    encoder = bpe.Encoder(vocab.inside, lambda pieces: (
        np.array(vocab.encoded(piece.decode(), {}), np.uint32).tobytes() for piece in pieces))
    chunk = text_buffer(pa.array(["one two six", "ten two"]))
    for left, right in zip(encoder.encode(*chunk), tokenfiles._library_encoder(PATH)[0].encode(*chunk)):
        assert left.tolist() == right.tolist()
