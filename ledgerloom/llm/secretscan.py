"""Secrets in texts, also inside nested encodings, by a worklist of decoded layers.

The text itself is the first layer. Every layer is scanned, then unwrapped: all percent, backslash and
character-reference escapes at once give one further layer, each base64 token another, and compressed
content of a token is unpacked first. A layer that was seen before is not taken again, so the list runs dry also
for content that unpacks to itself. Every layer knows which part of the original each of its characters came
from, and whatever is found is reported as a span of the original text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import chunked, in_tasks

KINDS = ("assign", "access", "hex")
#: Bytes that one document may unpack to in all; beyond it `cut_off` is set. Guards against archive bombs.
UNPACKED_BYTES = 1 << 30
#: Unpacked content is scanned in pieces of about this size, cut at line ends, which no secret crosses.
WINDOW_BYTES = 1 << 23
SHORTEST_TOKEN = 16
WRAPPED_LINE = 60

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

ESCAPE = re.compile(
    r"%(?:25)+|%[0-7][0-9A-Fa-f]|(?:%[89A-Fa-f][0-9A-Fa-f])+"
    r"|\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}"
    r"|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % SHORTEST_TOKEN)
LAST_LINE = re.compile(r"\r?\n([A-Za-z0-9+/_-]+)")

SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("base", T.BooleanType()), T.StructField("via", T.StringType())])


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of every secret written out in `text`."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


class Layer:
    """A text and where its characters came from.

    `at` holds the places where segments begin; segment i came from `start[i]` to `end[i]` of the original, character by
    character where `exact[i]`, else as a whole.
    """

    __slots__ = ("text", "at", "start", "end", "exact", "via")

    def __init__(self, text: str, at: list[int], start: list[int], end: list[int], exact: list[bool], via: str):
        self.text, self.at, self.start, self.end, self.exact, self.via = text, at, start, end, exact, via

    def span(self, begin: int, stop: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, begin) - 1, bisect_right(self.at, stop - 1) - 1
        low = self.start[i] + (begin - self.at[i] if self.exact[i] else 0)
        high = self.start[j] + stop - self.at[j] if self.exact[j] else self.end[j]
        return low, high

    def key(self) -> bytes:
        where = (self.at, self.start, self.end) if len(self.at) > 1 else (self.start[0], self.end[0])
        return blake2b(self.text.encode("utf-8", "surrogatepass") + b"\0" + repr(where).encode(), digest_size=16).digest()

    def copy_segments(self, begin: int, stop: int, place: int, out: Layer) -> None:
        """Append the segments of [begin, stop) to `out`, whose text there begins at `place`."""
        i = bisect_right(self.at, begin) - 1
        while begin < stop:
            upto = min(stop, self.at[i + 1] if i + 1 < len(self.at) else len(self.text))
            out.at.append(place)
            if self.exact[i]:
                low = self.start[i] + begin - self.at[i]
                out.start.append(low), out.end.append(low + upto - begin)
            else:
                out.start.append(self.start[i]), out.end.append(self.end[i])
            out.exact.append(self.exact[i])
            place, begin, i = place + upto - begin, upto, i + 1


def unescaped(mark: str) -> str:
    """The characters that one escape sequence stands for."""
    if mark[0] == "%":
        if mark.startswith("%25"):
            return "%"
        return bytes.fromhex(mark.replace("%", "")).decode("utf-8", "replace")
    if mark[0] == "&":
        code = int(mark[3:-1], 16) if mark[2] in "xX" else int(mark[2:-1])
    elif len(mark) == 12:
        code = 0x10000 + ((int(mark[2:6], 16) - 0xD800) << 10) + int(mark[8:], 16) - 0xDC00
    else:
        code = int(mark[2:].strip("{}"), 16)
    return "�" if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


def without_escapes(layer: Layer) -> Layer | None:
    """The layer with every escape sequence replaced, or None if it has none."""
    text = layer.text
    if "%" not in text and "\\" not in text and "&#" not in text:
        return None
    out, parts, done, place = Layer("", [], [], [], [], layer.via + ">escapes"), [], 0, 0
    for m in ESCAPE.finditer(text):
        if m.start() > done:
            layer.copy_segments(done, m.start(), place, out)
            parts.append(text[done: m.start()])
            place += m.start() - done
        shown = unescaped(m.group())
        low, high = layer.span(m.start(), m.end())
        out.at.append(place), out.start.append(low), out.end.append(high), out.exact.append(False)
        parts.append(shown)
        place, done = place + len(shown), m.end()
    if not parts:
        return None
    if done < len(text):
        layer.copy_segments(done, len(text), place, out)
        parts.append(text[done:])
    out.text = "".join(parts)
    return out


def tokens(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Base64 tokens with start and end, each with those that continue it on the next lines, as mail and key files wrap."""
    lines: list[tuple[int, int, str]] = []
    for m in TOKEN.finditer(text):
        if lines and not (lines[-1][1] - lines[-1][0] >= WRAPPED_LINE and text[lines[-1][1]: m.start()] in ("\n", "\r\n")):
            yield lines
            lines = []
        lines.append((m.start(), m.end(), m.group()))
        if m.end() - m.start() >= WRAPPED_LINE:
            last = LAST_LINE.match(text, m.end())
            if last and len(last[1]) < SHORTEST_TOKEN:
                yield [*lines, (last.start(1), last.end(), last[1])]
                lines = []
    if lines:
        yield lines


def bytes_of(token: str) -> bytes | None:
    if len(token) % 4 == 1:
        return None
    try:
        return base64.b64decode(token.replace("-", "+").replace("_", "/") + "=" * (-len(token) % 4), validate=True)
    except binascii.Error:
        return None


def readable(head: bytes) -> bool:
    """Whether it is text, of which the last character may be cut; "x " and "x^" begin both texts and zlib streams."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        return False
    return True


def unpacker(head: bytes):
    """Name and decompressor of a compressed format by its first bytes, or None."""
    if head[:2] == b"\x1f\x8b":
        return "gzip", zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return "bzip2", bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return "xz", lzma.LZMADecompressor(memlimit=1 << 28)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", None
    if len(head) > 2 and head[0] == 0x78 and (head[0] << 8 | head[1]) % 31 == 0 and not readable(head):
        return "zlib", zlib.decompressobj(15)
    return None


class Budget:
    def __init__(self, left: int):
        self.left, self.spent = left, False

    def take(self, n: int) -> bool:
        self.left -= n
        self.spent = self.spent or self.left < 0
        return not self.spent


class Source:
    """Blocks as a file, for the one library that wants to read."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks = blocks

    def read(self, _: int = -1) -> bytes:
        return next(self.blocks, b"")


def unzstd(blocks: Iterator[bytes]) -> Iterator[bytes]:
    import zstandard

    reader = zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(Source(blocks))
    try:
        while out := reader.read(WINDOW_BYTES):
            yield out
    except zstandard.ZstdError:
        return


def unpacked(name: str, worker, blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Unpacked blocks of at most WINDOW_BYTES; ends quietly where the content is broken off or damaged."""
    if name == "zstd":
        yield from unzstd(blocks)
        return
    try:
        for block in blocks:
            more = True
            while more and not worker.eof:
                out = worker.decompress(block, WINDOW_BYTES)
                if name in ("gzip", "zlib"):
                    block = worker.unconsumed_tail
                    more = bool(block) or len(out) == WINDOW_BYTES
                else:
                    block, more = b"", not worker.eof and not worker.needs_input
                if out:
                    yield out
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return


def within(budget: Budget, blocks: Iterator[bytes]) -> Iterator[bytes]:
    for block in blocks:
        if not budget.take(len(block)):
            return
        yield block


def texts_of(data: bytes, budget: Budget) -> Iterator[tuple[str, str]]:
    """Pieces of text, and how they were wrapped, that a token's bytes hold; nothing where they hold none."""
    blocks, via, heads = iter([data]), "", set()
    first = next(blocks)
    while (found := unpacker(first)) is not None:
        mark = blake2b(first, digest_size=16).digest()
        if mark in heads:
            return
        heads.add(mark)
        blocks = within(budget, unpacked(*found, _chain(first, blocks)))
        via += ">" + found[0]
        first = next(blocks, b"")
    if not first:
        return
    wide = "utf-16-le" if len(first) > 3 and not any(first[1::2]) and all(first[0::2]) else "utf-8"
    decoder, rest = codecs.getincrementaldecoder(wide)(), ""
    try:
        for block in _chain(first, blocks):
            rest += decoder.decode(block)
            cut = rest.rfind("\n") + 1
            if len(rest) >= WINDOW_BYTES and cut:
                yield rest[:cut], via
                rest = rest[cut:]
        rest += decoder.decode(b"", final=not via)
    except UnicodeDecodeError:
        if not via:
            return
    if rest:
        yield rest, via


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def readings(lines: list[tuple[int, int, str]]) -> Iterator[list[tuple[int, int, str]]]:
    """Ways to read wrapped lines, to be tried in turn until one gives text: as one token, line by line, between slashes."""
    if len(lines) > 1:
        yield [(lines[0][0], lines[-1][1], "".join(line for _, _, line in lines))]
    yield lines
    yield [(begin + part.start(), begin + part.end(), part.group()) for begin, _, line in lines if "/" in line
           for part in re.finditer(r"[^/]{%d,}" % SHORTEST_TOKEN, line)]


def children(layer: Layer, budget: Budget) -> Iterator[Layer]:
    plain = without_escapes(layer)
    if plain is not None:
        yield plain
    for lines in tokens(layer.text):
        for reading in readings(lines):
            held = False
            for begin, stop, token in reading:
                data = bytes_of(token)
                low, high = layer.span(begin, stop)
                for text, via in texts_of(data, budget) if data else ():
                    held = True
                    yield Layer(text, [0], [low], [high], [False], f"{layer.via}>base64{via}")
            if held:
                break


def secrets(text: str, unpacked_bytes: int = UNPACKED_BYTES) -> tuple[list[tuple[str, int, int, bool, str]], bool]:
    """All spans as (kind, start, end, written out, path of wrappings), ordered, and whether the budget ran out."""
    base = set(matches(text))
    found = {span: "" for span in base}
    budget, seen = Budget(unpacked_bytes), set()
    root = Layer(text, [0], [0], [len(text)], [True], "")
    work = [children(root, budget)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = layer.key()
        if key in seen:
            continue
        seen.add(key)
        for kind, begin, stop in matches(layer.text):
            found.setdefault((kind, *layer.span(begin, stop)), layer.via[1:])
        work.append(children(layer, budget))
    ordered = sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [(*span, span in base, found[span]) for span in ordered], budget.spent


def scan_batches(unpacked_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("via", pa.string())])
    names = ("kind", "start", "end", "base", "via")
    for batch in chunked(batches, "text"):
        spans, cut = [], []
        for value in batch.column("text"):
            found, spent = secrets(value.as_py() or "", unpacked_bytes)
            spans.append([dict(zip(names, row)) for row in found])
            cut.append(spent)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(spans, pa.list_(span)), pa.array(cut, pa.bool_())], ["doc_id", "spans", "cut_off"])


def scan_secrets(docs: DataFrame, unpacked_bytes: int = UNPACKED_BYTES) -> DataFrame:
    """doc_id, `spans` and `cut_off` of every row of `docs`, in one pass without a shuffle.

    A span has its kind, start and end (code points of the original text, end exclusive), whether it is written out there
    (`base`), and else the wrappings it was found under, outermost first. Base spans are always kept. Spans are
    distinct, ordered by start, kind and end. A null or empty text has none. `doc_id` may be of any type, null or
    repeated; every row gives one row. Other columns are neither read nor returned, whatever their names. A text is
    held whole by one task, whatever its length; what it unpacks to is scanned in pieces. `cut_off` says that
    a document unpacked to more than `unpacked_bytes` and that content beyond them was not looked at.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("cut_off", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(in_tasks(scan_batches, unpacked_bytes), schema)


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the spans written out in each text, and all spans as `kind:start:end`."""
    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def of_kind(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return scan_secrets(docs).select(
        "doc_id", *[of_kind(kind) for kind in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda s: ~s["base"]), lambda s: s["via"]))), ",")
        .alias("wrappings"), "cut_off")
