"""Small inputs that the tests of the text operators share."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_no string, doc string, key int, shard string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n_words):
    """Made-up sentences of made-up words, a line break here and there."""
    out = []
    for i in range(n_words):
        word = "".join(rng.choice(["ka", "lo", "mi", "ter", "sen", "où", "ß", "dra"]) for _ in range(rng.randint(1, 3)))
        out.append(word + rng.choice(["", "", "", "", ". ", ", ", ".\n"]))
    return " ".join(out)


def documents(spark, seed=1, n=60):
    """Prose with copies, near copies, shared passages, and rows that are odd in every column."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([0, 1, 3, 20, 80, 200])) for _ in range(n)]
    shared = prose(rng, 70).replace("\n", " ")
    for i in range(0, n, 7):
        texts[i] = f"{prose(rng, 30)} {shared} {prose(rng, 30)}"
    texts += [texts[1], texts[1], texts[5] + " end", texts[8].replace(" ", "  ")]
    rows = [(i, text, rng.choice(["en", "fr", None]), "s", len(text)) for i, text in enumerate(texts)]
    rows += [(None, texts[2], None, None, None), (None, None, "en", None, 3), (3, texts[3], "en", "s", 1), (3, texts[3], "en", "s", 1),
             (900, "", "en", "s", 0), (901, None, "en", "s", 0), (902, " \t\n ", "fr", "s", 4), (903, "x" * 5000, "en", "s", 0),
             (904, "one", "en", "s", 3), (905, "A\x00B \x0b c\r\nd", "en", "s", 0), (-4, "日本 語 \U0001f600", "ja", "s", 0),
             (906, "word " * 3000, "en", "s", 0), (907, "\n".join(["same line"] * 40), "en", "s", 0)]
    return spark.createDataFrame([(*row, "r", "d", 1, "z") for row in rows], DOCS)


def empty_like(df):
    return df.limit(0)


def lower_ascii(text):
    return (text or "").translate(LOWER)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))


def counted(rows):
    from collections import Counter

    return Counter(tuple(r) for r in rows)


class Groups:
    """A plain union-find."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        self.up[self.find(i)] = self.find(j)
