"""Column functions over inputs drawn from the grammar each of them documents."""

import hashlib
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.dates import clamp_day, iso_week_key, month_bounds, parse_date, shift_month, trailing
from ledgerloom.functions.hashing import booking_id, booking_text
from ledgerloom.functions.money import format_eur, ordinal, parse_cents, plain_amount
from ledgerloom.functions.names import (
    DEFAULT_NAME_RULES, GLUED_PREFIXES, PLACES, SPACED_PREFIXES, STARRED_PREFIXES, NameRules, display_name, merchant_key,
)



def evaluate(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def amounts(n=400):
    rng = random.Random(21)
    return [0, *(rng.choice([-1, 1]) * int(10 ** rng.uniform(0, 15)) for _ in range(n))]


# ── money ──

def test_every_way_to_write_an_amount_reads_back(spark):
    rng = random.Random(22)
    cents = amounts()

    def written(c):
        whole, rest = divmod(abs(c), 100)
        head = rng.choice([str(whole), f"{whole:,}"])
        tail = rng.choice([f".{rest:02d}"] + ([f".{rest // 10}"] if rest % 10 == 0 else []) + ([""] if rest == 0 else []))
        return rng.choice(["", " ", "\t"]) + ("-" if c < 0 else rng.choice(["", "+"])) + head + tail + rng.choice(["", " "])

    assert evaluate(spark, [written(c) for c in cents], parse_cents) == cents


def test_printed_amounts_read_back(spark):
    df = spark.createDataFrame([(c,) for c in amounts()], "c long")
    shown = df.select("c", plain_amount(F.col("c")).alias("plain"), format_eur(F.col("c")).alias("eur"))
    again = shown.select("c", parse_cents(F.col("plain")).alias("p"), parse_cents(F.col("eur")).alias("e"))
    assert all(r.c == r.p == r.e for r in again.collect())


def test_damaged_amounts_are_refused(spark):
    rng = random.Random(23)
    bad = []
    for c in amounts(150):
        text = f"{abs(c) // 100}.{abs(c) % 100:02d}"
        bad += [text + str(rng.randrange(10)), text.replace(".", ".."), text + rng.choice("abz%"), "--" + text, text + "-",
                text.replace(".", ","), "," + text]
    assert set(evaluate(spark, [*bad, "", " ", None], parse_cents)) == {None}


def test_ordinal_endings(spark):
    shown = evaluate(spark, list(range(1, 1_200)), ordinal, "long")
    assert [int(re.match(r"\d+", s)[0]) for s in shown] == list(range(1, 1_200))
    teens = {s[-2:] for n, s in enumerate(shown, 1) if n // 10 % 10 == 1}
    assert teens == {"th"}
    ends = {n % 10: s[-2:] for n, s in enumerate(shown, 1) if n // 10 % 10 != 1}
    assert ends == {1: "st", 2: "nd", 3: "rd"} | {d: "th" for d in (0, 4, 5, 6, 7, 8, 9)}


# ── dates ──

def days(n=300):
    rng = random.Random(24)
    return [date(1969, 1, 1) + timedelta(days=rng.randrange(36_500)) for _ in range(n)]


def test_every_date_form_reads_back(spark):
    for form in ("%d/%m/%Y", "%Y-%m-%d", "%d/%m/%y"):
        mine = days()
        assert evaluate(spark, [f" {d:{form}} " for d in mine], parse_date) == mine
    bare = [d for d in days() if d.day < 10 and d.month < 10]
    assert evaluate(spark, [f"{d.day}/{d.month}/{d.year}" for d in bare], parse_date) == bare


def test_dates_that_do_not_exist_are_refused(spark):
    bad = [f"{d.day:02d}/{m:02d}/{d.year}" for d in days(40) for m in (0, 13, 19)]
    bad += [f"{y}-02-30" for y in range(1990, 2030)] + [f"29/02/{y}" for y in range(1991, 2031, 4)]
    bad += [f"{d.year}/{d.month:02d}/{d.day:02d}" for d in days(10)] + [f"{d:%d/%m/}0{d:%y}" for d in days(10)]
    assert set(evaluate(spark, [*bad, "", " ", "tomorrow", None], parse_date)) == {None}


def test_iso_weeks_equal_the_calendar(spark):
    mine = days(1_500)
    want = ["{0}-W{1:02d}".format(*d.isocalendar()) for d in mine]
    assert evaluate(spark, mine, iso_week_key, "date") == want


def test_month_arithmetic():
    for d in days():
        first, last, n = month_bounds(d)
        assert first <= d <= last and (last - first).days + 1 == n and (last + timedelta(days=1)).day == 1
        assert shift_month(shift_month(first, 7), -7) == first and shift_month(first, -12).year == first.year - 1
        assert clamp_day(first, 31) == last and clamp_day(first, 1) == first
        start, end = trailing(d, 45)
        assert end == d and (end - start).days == 45


# ── names ──

WORDS = ["harbour", "lantern", "Moss", "quill", "Ember", "TIDE", "birch"]


def codes(rng):
    return rng.choice([lambda: f"{rng.randrange(1, 99_999)}", lambda: f"#{rng.randrange(99)}", lambda: f"{rng.randrange(1, 29)}Mar",
                       lambda: f"{rng.randrange(1, 29)}/{rng.randrange(1, 13)}", lambda: f"d{rng.randrange(1, 25)}"])()


def prefixes(rng):
    kind = rng.randrange(3)
    return (f"{rng.choice(STARRED_PREFIXES)} *", rng.choice(GLUED_PREFIXES), f"{rng.choice(SPACED_PREFIXES)} ")[kind]


def names(n=600):
    """Raw names with the words that must be left of them."""
    rng = random.Random(25)
    for _ in range(n):
        base = rng.sample(WORDS, rng.randint(1, 4))
        tail = [rng.choice([codes(rng), rng.choice(PLACES).title()]) for _ in range(rng.randint(0, 4))]
        if tail and len(base) == 1:
            tail[0] = codes(rng)
        front = "".join(prefixes(rng) for _ in range(rng.randint(0, 3)))
        note = rng.choice(["", " {seen : 2031-02-03}"])
        yield front + rng.choice([" ", "  "]).join([*base, *tail]) + note, " ".join(base).upper()


def test_only_prefixes_and_tails_are_cut(spark):
    raws, wanted = zip(*names())
    assert evaluate(spark, raws, merchant_key) == list(wanted)


def test_keys_do_not_change_when_applied_again(spark):
    raws = [raw for raw, _ in names()] + ["Cork", "12", "POS ", "zettle_", "{ } x", "VDP-VDP-", "d4 d5 d6", "Bray Bray Bray"]
    once = evaluate(spark, raws, merchant_key)
    assert evaluate(spark, once, merchant_key) == once and all(once)


def test_nothing_is_left_of_nothing(spark):
    assert evaluate(spark, [None, "", " \t "], merchant_key) == [""] * 3
    assert evaluate(spark, [None, "", " \t "], display_name) == [""] * 3


def test_a_place_needs_two_words_before_it(spark):
    for place in PLACES:
        got = evaluate(spark, [f"Moss {place}", f"Moss Tide {place}", place], merchant_key)
        assert got == [f"MOSS {place}", "MOSS TIDE", place]


def test_very_long_names(spark):
    """A hundred thousand tokens on either side of the last word that counts."""
    n = 100_000
    body, tail, front = "w " * n + "END", " 12 CORK" * (n // 2), "POS " * n
    assert evaluate(spark, [body + tail, front + "TIDE MOSS", "TIDE" + " 7" * n], merchant_key) == [
        body.upper(), "TIDE MOSS", "TIDE"]


def test_own_rules_replace_the_given_ones(spark):
    rules = NameRules(starred=("TILL",), glued=("X-",), spaced=("AT",), places=("HEREFORD",), codes=(r"\d{3}",))
    got = evaluate(spark, ["till*Moss Tide 123 Hereford", "at x-Moss 12", "POS Moss"], lambda c: merchant_key(c, rules))
    assert got == ["MOSS TIDE", "MOSS 12", "POS MOSS"]
    assert DEFAULT_NAME_RULES.places == PLACES
    with pytest.raises(ValueError):
        NameRules(places=("TWO WORDS",))


def test_display_name_keeps_case_and_drops_the_note(spark):
    raws = [raw for raw, _ in names(100)]
    assert evaluate(spark, raws, display_name) == [raw.partition("{")[0].strip() for raw in raws]


# ── ids ──

def test_ids_tell_bookings_and_repeats_apart(spark):
    rng = random.Random(26)
    rows = {(d, rng.randrange(-9_000, 9_000), rng.choice([*WORDS, None]), rng.choice(["p", "q"])) for d in days(80)}
    df = spark.createDataFrame(list(rows), "d date, c long, m string, a string")
    text = booking_text(F.col("d"), F.col("c"), F.col("m"), F.col("a"))
    got = df.select("*", *[booking_id(text, F.lit(i)).alias(f"n{i}") for i in range(3)]).collect()
    assert len({r[f"n{i}"] for r in got for i in range(3)}) == 3 * len(rows)
    for r in got:
        parts = "|".join([r.d.isoformat(), str(r.c), r.m or "", r.a])
        assert r.n0 == hashlib.sha256(parts.encode()).hexdigest()
