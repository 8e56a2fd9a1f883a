import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
from llm_cases import documents, empty_like, item_words, prose
from pyspark.sql import functions as F

from ledgerloom.llm import passages, shared
from ledgerloom.llm.queries import QUERIES


def text_of(rng, n):
    return prose(rng, n).replace("\n", " ")


def test_passages_inside_other_text_are_found(spark):
    rng = random.Random(9)
    shared = [text_of(rng, 60) for _ in range(6)]
    shared = [s.strip() + " end." for s in shared]
    rows = []
    for i in range(60):
        parts = [text_of(rng, rng.randint(5, 90))]
        if i % 2:
            parts += [shared[i % 6], text_of(rng, rng.randint(0, 90))]
        rows.append((i, " ".join(parts)))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = {s: min(i for i, _ in rows if i % 2 and i % 6 == s) for s in range(6) if s % 2}
    want = {i for i, _ in rows if i % 2 and i != first[i % 6]}
    assert {r.doc_id for r in found} == want
    texts = dict(rows)
    for r in found:
        assert r.keep_id == first[r.doc_id % 6]
        cut = texts[r.doc_id].encode()[r.start_byte:r.stop_byte].decode()
        here, there = cut.split(), texts[r.keep_id].split()
        assert r.n_words == r.stop - r.start == len(here) >= passages.MIN_PASSAGE
        assert sum(word in there for word in here) >= passages.THRESHOLD * len(here)


def test_near_copies_of_a_paragraph_are_found(spark):
    rng = random.Random(3)
    words = text_of(rng, 120).split()
    changed = words[:60] + ["other"] + words[61:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, text_of(rng, 120))], "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    assert {(r.doc_id, r.keep_id) for r in found} == {(2, 1)}


def test_odd_rows_and_empty_tables(spark):
    docs = documents(spark)
    found = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} >= {7 * i for i in range(1, 8)}
    assert all(r.doc_id is None or r.doc_id > r.keep_id or r.doc_id == 3 for r in found)
    assert passages.repeated_passages(empty_like(docs)).count() == 0


def test_bands_reach_the_recall():
    assert passages.bands_for(0.8, 0.95) == 3 and passages.bands_for(0.8, 0.99) == 5


def test_jaccard_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 30))) for _ in range(25)] + [np.array([], np.int64)]
    group = pa.table({"shingles": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
    linked = passages.similar(group, 0.5)
    for i, a in enumerate(sets[:-1]):
        for j, b in enumerate(sets[:-1]):
            assert linked[i, j] == (len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)))


def test_paragraphs_do_not_depend_on_the_chunk():
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 3, 200, 24, 25, 26, 400)] + [None, "\n\n", "w " * 60]
    whole = passages.Paragraphs(pa.array(texts))
    apart = [passages.Paragraphs(pa.array([t], pa.string())) for t in texts]
    assert set(whole.keys[whole.valid].tolist()) == {k for p in apart for k in p.keys[p.valid].tolist()}
    assert len(whole.starts) == sum(len(p.starts) for p in apart)
    content = whole.contents(np.arange(len(whole.starts)))
    assert set(content.tolist()) == {c for p in apart for c in p.contents(np.arange(len(p.starts))).tolist()}


def own_words(name, n):
    """Words that no other text has."""
    return [f"{name}x{i}" for i in range(n)]


def test_runs_over_line_breaks_are_found_to_their_ends(spark):
    """Every shared run of MIN_PASSAGE words or more, by brute force, whatever the lines; a run of one word less stays."""
    sizes = [30, 31, 37, 51, 80, 29]
    run = {n: own_words(f"run{n}", n) for n in sizes}
    rows = []
    for place, n in enumerate(sizes):
        for doc, width in ((2 * place, 13), (2 * place + 1, 7)):
            words = own_words(f"a{doc}", 40) + run[n] + own_words(f"b{doc}", 40)
            rows.append((doc, "\n".join(" ".join(words[i:i + width]) for i in range(0, len(words), width))))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    got = {(r.doc_id, r.keep_id): texts[r.doc_id].encode()[r.start_byte:r.stop_byte].decode().split() for r in found}
    assert got == {(2 * place + 1, 2 * place): run[n] for place, n in enumerate(sizes[:-1])}
    assert {(r.start, r.stop, r.n_words) for r in found} == {(40, 40 + n, n) for n in sizes[:-1]}


def test_near_copies_inside_a_longer_line_are_found(spark):
    """One changed word: the middle one of 60 and of 61, the fortieth of 120, and blocks of a text of one line."""
    rows, want = [], {}
    for place, (n, at) in enumerate([(60, 29), (61, 30), (120, 39)]):
        words = own_words(f"p{place}w", n)
        for doc in (2 * place, 2 * place + 1):
            words = words[:at] + [f"other{doc}"] + words[at + 1:]
            rows.append((doc, " ".join(own_words(f"a{doc}", 45) + words + own_words(f"b{doc}", 45))))
        want[2 * place + 1] = 2 * place
    texts = dict(rows)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.keep_id for r in found} == want
    for r in found:
        cut = texts[r.doc_id].encode()[r.start_byte:r.stop_byte].decode().split()
        assert len(cut) == r.n_words and cut[0] in texts[r.keep_id].split() and cut[-1] in texts[r.keep_id].split()
    whole = {r.doc_id: r.n_words for r in found}
    assert whole[1] >= 30 and whole[3] == 61 and whole[5] == 120


def test_blocks_do_not_depend_on_the_text_around_them():
    words = own_words("w", 1500)
    a = passages.Paragraphs(pa.array([" ".join(own_words("a", 200) + words)]))
    b = passages.Paragraphs(pa.array(["\n".join(own_words("b", 333) + words)]))
    blocks = [set(p.contents(np.arange(p.lines)).tolist()) for p in (a, b)]
    sizes = (a.stops - a.starts)[:a.lines]
    assert len(blocks[0] & blocks[1]) >= 8 and sorted(sizes)[2] > passages.CUT_RADIUS


def shingles(words):
    return {tuple(words[i:i + passages.SHINGLE]) for i in range(len(words) - passages.SHINGLE + 1)}


def band_recall(n_pairs):
    """Share of pairs with a Jaccard index of 0.80 to 0.82, by brute force, that share a band, and the number of pairs."""
    rng = random.Random(5)
    met = pairs = 0
    for pair in range(n_pairs):
        words = own_words(f"p{pair}w", 100)
        other = list(words)
        for at in (rng.randint(5, 45), rng.randint(55, 94)):
            other[at] = f"other{pair}x{at}"
        a, b = shingles(words), shingles(other)
        if not passages.THRESHOLD <= len(a & b) / len(a | b) <= 0.82:
            continue
        found = [passages.Paragraphs(pa.array([" ".join(w)])) for w in (words, other)]
        keys = [p.keys[np.flatnonzero(p.stops - p.starts == 100)[0]] for p in found]
        met += bool((keys[0] == keys[1]).any())
        pairs += 1
    return met / pairs, pairs


def test_pairs_at_the_threshold_are_compared():
    recall, pairs = band_recall(1000)
    assert pairs > 900 and recall >= 0.998


def test_no_shared_run_of_a_whole_table_is_lost(spark):
    """Every stretch of MIN_PASSAGE words that an earlier document holds, by brute force over all of sf0.01.

    A run of under 40 words may be told shorter than it is, where an earlier text than the one that has it whole has a part of it.
    """
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: item_words(r.text) for r in docs.select("doc_id", "text").collect()}
    first: dict[int, int] = {}
    shared = {}
    for doc in sorted(texts):
        words = texts[doc]
        hashes = [hash(tuple(words[i:i + passages.MIN_PASSAGE])) for i in range(len(words) - passages.MIN_PASSAGE + 1)]
        shared[doc] = [i for i, h in enumerate(hashes) if first.get(h, doc) < doc]
        for h in hashes:
            first.setdefault(h, doc)
    gone = {}
    for r in QUERIES["op10_passages"](spark, folder).collect():
        assert r.keep_id < r.doc_id and r.n_words >= passages.MIN_PASSAGE
        gone.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    total = sum(map(len, shared.values()))
    lost = [(doc, i) for doc, places in shared.items() for i in places if not gone.get(doc, set()) & set(range(i, i + passages.MIN_PASSAGE))]
    partly = [1 for doc, places in shared.items() for i in places if not set(range(i, i + passages.MIN_PASSAGE)) <= gone.get(doc, set())]
    run_of = {}
    for doc, places in shared.items():
        for i in reversed(places):
            run_of[doc, i] = run_of.get((doc, i + 1), passages.MIN_PASSAGE - 1) + 1
    length = {(doc, i): n if (doc, i - 1) not in run_of else 0 for (doc, i), n in run_of.items()}
    whole = {}
    for doc, i in sorted(run_of):
        whole[doc, i] = length[doc, i] or whole[doc, i - 1]
    assert total > 10_000 and len(lost) <= total / 1000 and len(partly) <= total / 100
    assert all(whole[spot] < 40 for spot in lost)


def test_tables_and_shuffle_files_go_when_nothing_reads_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "_own_folder", lambda: str(tmp_path))
    blocks = spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    before = spark.conf.get(shared.SHUFFLE_CLEANUP, None)

    def shuffled():
        return {path for folder in blocks for path in Path(folder).rglob("shuffle_*.data")}

    old = shuffled()
    table = shared.saved(spark.range(10_000).groupBy((F.col("id") % 100).alias("key")).count().orderBy("key"), "table")
    until = time.monotonic() + 20
    while shuffled() - old and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffled() - old and spark.conf.get(shared.SHUFFLE_CLEANUP, None) == before
    assert table.count() == 100
    shared.dropped(table)
    assert not list(tmp_path.iterdir())

    found = passages.repeated_passages(documents(spark))
    left = {path.name.rsplit("-", 1)[0] for path in tmp_path.iterdir()}
    assert not left & {"units", "shared", "bands", "members", "shingles"}
    assert {r.doc_id for r in found.collect()} >= {7 * i for i in range(1, 8)}
