"""Token ids as binary files: range-coded blocks, then an index of the documents, each checksummed.

Documents are dealt by ranges of their id and sorted, so the files in order of their number hold all
ids in ascending order of document. A file is first written under a name of its own; only files that
the manifest names are ever read, so a task that is lost or repeated leaves nothing visible behind.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import ENCODED_BYTES, Encoder, certain_cuts, vocabulary
from ledgerloom.llm.mixcoder import BLOCK_IDS, HEADER, decode_block, encode_block
from ledgerloom.llm.shared import in_tasks, opened, saved, slices, text_buffer, work_folder

INDEX = struct.Struct("<4sQQI")
FOOTER = struct.Struct("<Q4s")
INDEX_MAGIC, FOOTER_MAGIC = b"MXI1", b"MXF1"
END_ID = 0
OUT_IDS = 1 << 19

MANIFEST = "part int, file string, n_docs long, n_tokens long, n_bytes long"
TOKENS = "doc_id long, start long, n_tokens long, ids binary"


@cache
def _library_encoder(path: str) -> tuple[Encoder, int]:
    """Encodes unseen pieces with the tokenizers library, laid end to end as one text.

    Pieces meet at certain cuts, so the ids of the joined text are the ids of the pieces one after the
    other; where two pieces do not meet at a certain cut, and after 256 of them, a new text begins.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, vocab = Tokenizer.from_file(path), vocabulary(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    sizes = np.array([len(vocab.tokens.get(number, b"")) for number in range(vocab.size)], np.int64)

    def fill(pieces: list[bytes]) -> list[bytes]:
        if not pieces:
            return []
        raw = b"".join(pieces)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        data = np.frombuffer(raw, np.uint8)
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 2:
            cut[certain_cuts(data, vocab.inside)] = True
        cut[ends[255::256]] = False
        breaks = ends[~cut[ends]]
        starts = np.concatenate([[0], breaks])
        texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), breaks.tolist())]
        ids = np.concatenate([np.array(e.ids, np.uint32)
                              for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] or [[]]).astype(np.uint32)
        places = np.searchsorted(np.cumsum(sizes[ids]), ends, "left") + 1
        places = np.where(ends == 0, 0, places)
        packed = ids.tobytes()
        bounds = [0, *(4 * places).tolist()]
        return [packed[a:b] for a, b in zip(bounds, bounds[1:])]

    return Encoder(vocab.inside, fill), vocab.size


def _write_file(tokenizer: str, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    encoder, alphabet = _library_encoder(tokenizer)
    part = TaskContext.get().partitionId()
    system, root = opened(folder)
    name = f"part-{part:06d}-{uuid.uuid4().hex}.mxt"
    waiting, held, n_tokens = [], 0, 0
    doc_ids, nulls, lengths = [], [], []
    with system.open_output_stream(f"{root}/{name}") as out:
        def flush(keep_rest: bool) -> None:
            nonlocal waiting, held
            ids = np.concatenate(waiting) if waiting else np.zeros(0, np.uint32)
            while len(ids) >= BLOCK_IDS or len(ids) and not keep_rest:
                out.write(encode_block(ids[:BLOCK_IDS], alphabet))
                ids = ids[BLOCK_IDS:]
            waiting, held = ([ids] if len(ids) else []), len(ids)

        def rest():
            yield first
            yield from batches

        for batch in rest():
            for piece in slices(batch, "text", ENCODED_BYTES):
                ids, bounds = encoder.encode(*text_buffer(piece.column("text")))
                ended = np.insert(ids, bounds[1:], END_ID)
                waiting.append(ended)
                held += len(ended)
                n_tokens += len(ended)
                lengths.append(np.diff(bounds) + 1)
                keys = piece.column("doc_id")
                nulls.append(keys.is_null().to_numpy(zero_copy_only=False))
                doc_ids.append(keys.fill_null(0).to_numpy(zero_copy_only=False))
                if held >= BLOCK_IDS:
                    flush(True)
        flush(False)
        index = np.concatenate(doc_ids).astype("<i8").tobytes() \
            + np.concatenate(lengths).astype("<i8").tobytes() + np.concatenate(nulls).astype(np.uint8).tobytes()
        n_docs, place = sum(map(len, doc_ids)), out.tell()
        out.write(INDEX.pack(INDEX_MAGIC, n_docs, len(index), zlib.crc32(index)) + index)
        out.write(FOOTER.pack(place, FOOTER_MAGIC))
        size = out.tell()
    yield pa.RecordBatch.from_pylist(
        [{"part": part, "file": name, "n_docs": n_docs, "n_tokens": n_tokens, "n_bytes": size}],
        pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()),
                   ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Write the ids of all texts below `folder`; return the manifest, one row per file.

    Each document's ids end with id 0; a null or empty text is that id alone. Rows are in ascending
    order of doc_id, nulls first; rows that share an id follow in the order they are read, and may be
    dealt to several tasks. `folder` must be one that every executor can write and read through pyarrow's file
    systems. An empty table writes no file. Columns other than doc_id and text are not stored.
    """
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    keys = [F.col("doc_id").asc_nulls_first(), F.col("row_no")]
    dealt = (
        docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_no"))
        .repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    )
    return saved(dealt.mapInArrow(in_tasks(_write_file, tokenizer, folder), MANIFEST), "manifest")


def _read_file(folder: str, name: str, base: int) -> Iterator[pa.RecordBatch]:
    system, root = opened(folder)
    with system.open_input_file(f"{root}/{name}") as file:
        file.seek(file.size() - FOOTER.size)
        place, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != FOOTER_MAGIC:
            raise ValueError(f"{name} has no footer")
        file.seek(place)
        magic, n_docs, size, check = INDEX.unpack(file.read(INDEX.size))
        index = file.read(size)
        if magic != INDEX_MAGIC or zlib.crc32(index) != check:
            raise ValueError(f"{name} has a damaged index")
        doc_ids = np.frombuffer(index, "<i8", n_docs)
        lengths = np.frombuffer(index, "<i8", n_docs, 8 * n_docs)
        nulls = np.frombuffer(index, np.uint8, n_docs, 16 * n_docs).astype(bool)
        ends = np.cumsum(lengths)
        file.seek(0)
        held, held_from, done = np.zeros(0, np.uint32), 0, 0
        while done < n_docs:
            if file.tell() < place:
                header = file.read(HEADER.size)
                ids = decode_block(header, file.read(HEADER.unpack(header)[4])).astype(np.uint32)
                held = np.concatenate([held, ids])
            whole = int(np.searchsorted(ends, held_from + len(held), "right"))
            while done < whole:
                start = int(ends[done] - lengths[done])
                stop = max(done + 1, min(whole, int(np.searchsorted(ends, start + OUT_IDS, "right"))))
                bounds = np.concatenate([[start], ends[done:stop]])
                data = held[start - held_from: int(bounds[-1]) - held_from].astype("<u4").tobytes()
                ids = pa.Array.from_buffers(pa.binary(), stop - done, [
                    None, pa.py_buffer((4 * (bounds - start)).astype(np.int32).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids[done:stop], mask=nulls[done:stop]), pa.array(bounds[:-1] + base),
                    pa.array(lengths[done:stop]), ids], ["doc_id", "start", "n_tokens", "ids"])
                done = stop
            rest = int(ends[done] - lengths[done]) if done < n_docs else held_from + len(held)
            held, held_from = held[rest - held_from:], rest


def _read_files(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield from _read_file(folder, row["file"], row["base"])


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents back from the files: doc_id, start among all ids, n_tokens, and the ids as
    little-endian unsigned 32-bit integers. A damaged block or index raises an error."""
    n_files = max(1, manifest.count())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    return placed.repartitionByRange(n_files, "part").mapInArrow(in_tasks(_read_files, folder), TOKENS)


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents, read the files back, and digest what they hold."""
    spark: SparkSession = docs.sparkSession
    folder = work_folder(spark, "tokens")
    manifest = write_tokens(docs, tokenizer, folder)
    return read_tokens(manifest, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
