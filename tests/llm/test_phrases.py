import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import documents, empty_like, lower_ascii

from ledgerloom.llm import phrases


def brute(rows, least=30, top=2000):
    """Rows of the result from (lang, text) pairs, by hand."""
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text)):
            row = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(row)
            for m in range(1, 5):
                counts[lang].update(tuple(row[i:i + m]) for i in range(len(row) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        ranked = []
        for p, a in found.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, words[lang], -score)
                for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def texts_of(seed, n):
    rng = random.Random(seed)
    common = ["der", "die", "das", "Haus", "ÉTÉ", "été", "a\x00b", "x" * 3000, "的", "k", "m", "q"]
    fixed = [["new", "york", "city", "hall"], ["san", "luis"], ["open", "source", "tool"]]
    rows = []
    for i in range(n):
        out = []
        while len(out) < rng.choice([0, 1, 4, 60, 200]):
            out += rng.choice(fixed) if rng.random() < 0.3 else [rng.choice(common)] * rng.choice([1, 1, 1, 3])
            out += [rng.choice([".", ",", "\n", "\t", "!", "", "", ""])] + [f"rare{rng.randrange(10 ** 6)}"] * (rng.random() < 0.05)
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), " ".join(out)))
    return rows + [("en", None), (None, None), ("fr", ""), ("en", " \t\n. ,"), ("zz", "once only")]


def table(spark, rows):
    return spark.createDataFrame([(lang, text, 1, "b", 2, "w") for lang, text in rows],
                                 "lang string, text string, a int, block string, n long, word string").repartition(5)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("entries, id_bits", [(1 << 20, None), (64, None), (500, 20), (1 << 20, 32)])
def test_collocations_equal_brute_force(spark, entries, id_bits):
    rows = texts_of(3, 250)
    assert result(phrases.collocations(table(spark, rows), entries=entries, id_bits=id_bits)) == brute(rows)


def test_ties_and_cuts_of_the_list_follow_bytes(spark):
    rows = [("en", "é z. é a. b ab. b a\tc. 𝒳 u. ｆ u")] * 30 + [("en", "solo")] * 5
    assert result(phrases.collocations(table(spark, rows), top=3)) == brute(rows, top=3)


def test_odd_and_empty_tables(spark):
    docs = documents(spark)
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert result(phrases.collocations(docs, least=4)) == brute(rows, least=4)
    assert phrases.collocations(empty_like(docs)).count() == 0
    assert phrases.collocations(docs.limit(1), least=10 ** 6).count() == 0


def test_a_phrase_in_a_third_of_all_rows(spark):
    rows = texts_of(5, 60) + [("en", "new york city hall new york city hall")] * 300 + [("fr", "word " * 5000)]
    assert result(phrases.collocations(table(spark, rows), entries=1000)) == brute(rows)


@pytest.mark.parametrize("id_bits", [8, 9, 20, 21, 31, 32])
def test_packed_phrases_can_be_read_again(id_bits):
    rng = np.random.default_rng(id_bits)
    ids = rng.integers(0, 1 << id_bits, 3000).astype(np.uint64) * (rng.random(3000) < 0.9)
    for length, halves in zip((2, 3, 4), phrases.n_grams(ids, id_bits)):
        assert all(int(h.max()) >> phrases.half_bits(length, id_bits) == 0 for h in halves)
        at = [i for i in range(len(ids) - length + 1) if ids[i:i + length].all()]
        want = [[int(ids[i + k]) if k < length else 0 for k in range(4)] for i in at]
        hi, lo = (x.view(np.uint64) for x in phrases.wide_ids(length, *halves, id_bits))
        assert [[int(h) >> 32, int(h) & 0xFFFFFFFF, int(o) >> 32, int(o) & 0xFFFFFFFF] for h, o in zip(hi, lo)] == want


@pytest.mark.parametrize("bits", [16, 32, 40, 64])
def test_filters_lose_nothing(bits):  # one counter in full, some single
    rng = np.random.default_rng(bits)
    mask = np.uint64((1 << bits) - 1)
    left, right = (rng.integers(0, 1 << 63, 5000, np.uint64) & mask for _ in range(2))
    back = phrases.restored(*phrases.permuted(left, right, bits), bits)
    assert all((a == b).all() for a, b in zip(back, (left, right)))
    repeats = np.concatenate((rng.integers(0, 400, 20000), np.arange(400, 1000), np.full(300, 7)))
    left, right, counts = phrases.tally(left[repeats], right[repeats], None, bits)
    assert counts.sum() == 20900 and len(left) == 1000 and counts.min() == 1
    twice = phrases.tally(np.tile(left, 9), np.tile(right, 9), np.tile(counts, 9), bits)
    assert (twice[0] == left).all() and (twice[2] == 9 * counts).all() and counts.max() > 255
    for cut_bits in (0, 3):
        cuts = (left.astype(np.uint64) >> np.uint64(bits - cut_bits)).astype(np.int64) if cut_bits else np.zeros(len(left), np.int64)
        for cut in np.unique(cuts):
            mine = cuts == cut
            data = phrases.packed_filter(left[mine], right[mine], counts[mine], bits, cut_bits)
            got = phrases.unpacked_filter(data, bits, cut_bits, int(cut))
            assert all((a == b[mine]).all() for a, b in zip(got, (left, right, counts)))
