import hashlib
from collections import defaultdict

import numpy as np
from llm_cases import counted, documents, empty_like, item_words

from ledgerloom.llm import decontam

ITEMS = "item_id long, text string"


def brute(docs, items, span=decontam.SPAN):
    windows = defaultdict(set)
    for item, text in items:
        words = item_words(text)
        size = min(span, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[i:i + size])].add(item)
    for doc_id, text in docs:
        words, hit, found = item_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (met := tuple(words[i:i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[met]
        names = ",".join(sorted(map(str, found)))
        yield (doc_id, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(),
               len(hit) > 0 and 20 * len(hit) >= len(words))


def test_equals_brute_force(spark):
    docs = documents(spark)
    texts = [r.text for r in docs.collect()]
    items = [(i, " ".join((texts[7 * i] or "").split()[25:25 + n])) for i, n in enumerate([40, 13, 14, 12, 5, 30])]
    items += [(20, items[0][1]), (20, items[0][1]), (21, None), (22, "..."), (23, "ONE"), (24, "ka lo"), (None, items[1][1])]
    items = [(i, t) for i, t in items if i is not None]
    got = decontam.contamination(docs, spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS hash", "'x' AS span"))
    want = counted(brute([(r.doc_id, r.text) for r in docs.collect()], items))
    assert counted(got.collect()) == want
    assert any(row[5] for row in want)


def test_empty_tables(spark):
    docs, none = documents(spark), spark.createDataFrame([], ITEMS)
    assert decontam.contamination(empty_like(docs), none).count() == 0
    assert all(r.n_items == 0 and not r.contaminated for r in decontam.contamination(docs, none).collect())


def test_stage_keeps_columns_and_clean_rows(spark):
    docs = documents(spark)
    text = docs.filter("doc_id = 7").first().text
    items = spark.createDataFrame([(1, " ".join(text.split()[:60]))], ITEMS)
    left = decontam.without_contaminated(docs, items)
    bad = [r.doc_id for r in decontam.contamination(docs, items).collect() if r.contaminated]
    assert left.columns == docs.columns
    assert 7 in bad and left.count() == docs.count() - len(bad)


def test_window_minima_hold_every_shared_span():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 9, 400).astype(np.uint64)
    other = np.concatenate([rng.integers(9, 20, 50).astype(np.uint64), words[100:113], rng.integers(9, 20, 9).astype(np.uint64)])
    places, hashes = decontam.winnowed(words, np.array([0, 400]), 13)
    theirs, their_hashes = decontam.winnowed(other, np.array([0, len(other)]), 13)
    mine = dict(zip(places.tolist(), hashes.tolist()))
    assert any(mine.get(p + 50) == h for p, h in zip(theirs.tolist(), their_hashes.tolist()) if 50 <= p < 63)
