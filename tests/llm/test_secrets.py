import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib
from urllib.parse import quote

import pytest
import zstandard
from llm_cases import documents, empty_like
from pyspark.sql import functions as F

from ledgerloom.llm import secretscan
from ledgerloom.llm.queries import QUERIES

ASSIGN = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
                    + "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
SECRET = "password = abcdefgh12"


def written_out(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)]


def digest_row(text):
    spans = written_out(text or "")
    listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return (*[sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex")], hashlib.sha256(listed.encode()).hexdigest())


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def made_texts(seed=1, n=400):
    rng = random.Random(seed)
    parts = ["token", "Secret", "API_KEY", "apikey", "passwd", "paſſword", "=", ":", " ", "  ", "'", '"', "abc", "abcdefgh", "AKIA", "AKIAABCDEFGH1234",
             "deadbeef" * 4, "0123abcd" * 5, "é", "\n", "=", "x.y-z_", "\U0001f600", ":", "="]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_base_spans_equal_brute_force(spark):
    texts = made_texts() + [None, "", "a" * 200_000, "token=" + "b" * 100_000]
    docs = spark.createDataFrame([(i, t, "s", True, 0) for i, t in enumerate(texts)],
                                 "doc_id long, text string, spans string, cut_off boolean, base int")
    for row in secretscan.secret_digests(docs).collect():
        assert (row.n_assign, row.n_access, row.n_hex, row.base_sha256) == digest_row(texts[row.doc_id])
        spans = row.spans.split(",") if row.spans else []
        assert set(f"{k}:{s}:{e}" for k, s, e in written_out(texts[row.doc_id] or "")) <= set(spans) and not row.cut_off


@pytest.mark.parametrize("wrap, via", [
    (lambda s: b64(s), "base64"),
    (lambda s: base64.urlsafe_b64encode(b"???>>>~~~" + b"\n" + s.encode()).decode().rstrip("="), "base64"),
    (lambda s: base64.encodebytes(s.encode() + b" lorem ipsum" * 30).decode().rstrip("\n="), "base64"),
    (lambda s: b64(s.encode("utf-16-le")), "base64"),
    (lambda s: b64(gzip.compress(s.encode())), "base64>gzip"),
    (lambda s: b64(zlib.compress(s.encode())), "base64>zlib"),
    (lambda s: b64(bz2.compress(s.encode())), "base64>bzip2"),
    (lambda s: b64(lzma.compress(s.encode())), "base64>xz"),
    (lambda s: b64(zstandard.compress(s.encode())), "base64>zstd"),
    (lambda s: b64(gzip.compress(zlib.compress(s.encode()))), "base64>gzip>zlib"),
    (lambda s: b64(gzip.compress(b64(b64(s)).encode())), "base64>gzip>base64>base64"),
    (lambda s: quote(quote(b64(s), safe=""), safe="").replace("=", "%3D"), "escapes>base64"),
    (lambda s: "".join(f"%{b:02X}" for b in s.encode()), "escapes"),
    (lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "escapes"),
    (lambda s: "".join(f"\\x{ord(c):02x}" for c in s), "escapes"),
    (lambda s: "".join(f"&#{ord(c)};" for c in s), "escapes"),
    (lambda s: b64("".join(f"\\u{{{ord(c):x}}}" for c in s)), "base64>escapes"),
])
def test_wrapped_secrets_map_to_their_place(wrap, via):
    hidden = wrap(SECRET)
    text = f"Été \U0001f600 before {hidden} after"
    begin = text.index(hidden)
    spans, cut = secretscan.secrets(text)
    assert not cut and [s[0] for s in spans] == ["assign"] and not spans[0][3]
    assert begin <= spans[0][1] < spans[0][2] <= begin + len(hidden.rstrip("=")) + 2
    path = spans[0][4]
    assert path == via or (via == "escapes>base64" and path in ("escapes>escapes>base64", "base64"))


def test_partly_escaped_secrets_keep_exact_borders():
    text = "see token%3Dab%2543cdefgh! and token=%61bcdefgh and password=kept%20here1234"
    got = {(k, text[s:e]) for k, s, e, _, _ in secretscan.secrets(text)[0]}
    assert ("assign", "token%3Dab%2543cdefgh") in got and ("assign", "token=%61bcdefgh") in got


def test_pairs_of_surrogates_and_broken_marks():
    text = "\\ud83d\\ude00 \\ud83d %zz %f0%9f%98%80 &#1114112; &#xD800; \\U0001F600 token=\\u0061bcdefgh"
    assert [(k, text[s:e]) for k, s, e, _, _ in secretscan.secrets(text)[0]] == [("assign", "token=\\u0061bcdefgh")]


def test_every_layer_is_scanned_and_none_twice():
    inner = b64("x " + SECRET)
    text = f"{b64('AKIAABCDEFGHIJKLMN and ' + inner)} {inner}"
    spans = secretscan.secrets(text)[0]
    assert [s[0] for s in spans] == ["assign", "access", "assign"]
    work = secretscan.secrets(" ".join([inner] * 50))[0]
    assert len(work) == 50


def test_content_that_unpacks_to_itself_ends(monkeypatch):
    calls = []

    class Echo:
        eof, unconsumed_tail = False, b""

        def decompress(self, data, limit):
            calls.append(1)
            return data

    monkeypatch.setattr(secretscan, "unpacker", lambda head: ("gzip", Echo()) if head[:2] == b"\x1f\x8b" else None)
    assert secretscan.secrets(b64(b"\x1f\x8b" + b"again" * 10)) == ([], False)
    assert len(calls) <= 2


def test_large_content_is_scanned_whole_and_bombs_are_told(monkeypatch):
    monkeypatch.setattr(secretscan, "WINDOW_BYTES", 1 << 12)
    plain = ("some words here\n" * 5000) + SECRET + "\n" + ("more words here\n" * 5000)
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        token = b64(pack(plain.encode())).rstrip("=")
        assert secretscan.secrets(token) == ([("assign", 0, len(token), False, secretscan.secrets(token)[0][0][4])], False)
        assert secretscan.secrets(token, unpacked_bytes=50_000) == ([], True)
    damaged = b64(gzip.compress(plain.encode())[:-30])
    assert secretscan.secrets(damaged)[1] is False


def test_long_texts_take_time_by_length_only():
    for text in ("x" * 2_000_000, "%" + "25" * 200_000 + "41", ("y" * 76 + "\n") * 20_000, "token " * 200_000, "a1" * 1_000_000):
        secretscan.secrets(text)


def test_odd_and_empty_tables(spark):
    docs = documents(spark)
    got = secretscan.secret_digests(docs)
    assert got.count() == docs.count() and secretscan.secret_digests(empty_like(docs)).count() == 0
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert dict(secretscan.scan_secrets(named).dtypes)["doc_id"] == "string"


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op12_secrets"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == digest_row(texts[r.doc_id])
