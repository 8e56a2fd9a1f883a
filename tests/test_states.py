"""Kept states of corrections and recurring charges: equal to a full rebuild, and no more is rewritten than was touched."""

import random
from datetime import date, datetime
from pathlib import Path

from conftest import rows_of
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.config import Rule
from ledgerloom.operators import recurring, rhythm
from ledgerloom.plans import refresh

RULES = [Rule("TEA", "Coffee/Snacks"), Rule("MARKET", "Groceries")]


def ledger_rows(spark, n=600, seed=5):
    rng = random.Random(seed)
    rows = [(f"t{i}", f"a{rng.randint(0, 9)}", date(2026, rng.randint(1, 6), rng.randint(1, 28)), rng.choice([-1999, -500, -501, 800]),
             rng.choice(["TEA", "MARKET", "RARE", "GYM", None]) if rng.random() < 0.98 else "ODD", i) for i in range(n)]
    rows += [(f"r{m}", "a1", date(2026, m, 27 + m % 2), -4_000 - m, "RENT CO", 1_000 + m) for m in range(1, 7)]
    rows += [(f"w{w}", "a2", date(2026, 5, 1 + 7 * w), -700, "PAPER", 2_000 + w) for w in range(4)] + [("w9", "a2", date(2026, 5, 8), -700, "PAPER", 2_009)]
    return spark.createDataFrame(rows, "id string, account_id string, booking_date date, amount_cents long, merchant_key string, batch_ord long").withColumn(
        "booking_month", F.date_format("booking_date", "yyyy-MM"))


def events_of(spark, *rows):
    return spark.createDataFrame([(f"e{i}", "owner", scope, txn, name, category, datetime(2026, 7, 1, 0, minute))
                                  for i, (scope, txn, name, category, minute) in enumerate(rows)], schema.LABEL_EVENTS)


def files_of(path):
    return {p.relative_to(path).as_posix() for p in Path(path).rglob("*.parquet")}


def test_a_correction_replaces_only_the_parts_it_touches(spark, tmp_path):
    ledger, path = ledger_rows(spark), str(tmp_path / "cube")
    old = events_of(spark, ("merchant", None, "GYM", "Health/Fitness", 1), ("txn", "t5", None, "Gifts", 2))
    fresh = events_of(spark, ("merchant", None, "ODD", "Travel", 3), ("txn", "t7", None, "Dates", 4), ("txn", "gone", None, "Dates", 4)).withColumn(
        "event_id", F.concat(F.lit("f"), "event_id"))
    every = old.unionByName(fresh)
    refresh.write_cube(refresh.month_cube(ledger, old, RULES), path)
    before = files_of(path)
    for _ in range(2):  # again after a crash
        refresh.correct_cube(path, ledger, every, fresh, RULES, str(tmp_path / "work"))
        stored = spark.read.parquet(path)
        whole = refresh.month_cube(ledger, every, RULES)
        assert rows_of(stored, *whole.columns) == rows_of(whole)
    touched = {(r.booking_month, r.slot) for r in refresh.touched_parts(fresh, ledger).collect()}
    assert 0 < len(touched) < len(before) / 2
    kept = {f for f in before if not any(f.startswith(f"booking_month={m}/slot={s}/") for m, s in touched)}
    assert kept == files_of(path) & before and len(kept) == len(before) - len(touched)


def test_corrections_as_a_table_equal_a_rebuild(spark):
    ledger = ledger_rows(spark)
    old, fresh = events_of(spark, ("merchant", None, "TEA", "Dining", 1)), events_of(spark, ("txn", "t3", None, "Gifts", 5))
    fresh = fresh.withColumn("event_id", F.lit("x"))
    both = old.unionByName(fresh)
    for keys in (["account_id"], []):
        got = refresh.corrected_cube(refresh.month_cube(ledger, old, RULES, keys), ledger, both, fresh, RULES, keys)
        want = refresh.month_cube(ledger, both, RULES, keys)
        assert rows_of(got, *want.columns) == rows_of(want)
    assert refresh.touched_parts(fresh.limit(0), ledger).count() == 0


def test_recurring_charges_from_months_equal_all_history(spark):
    ledger = ledger_rows(spark)
    limits = recurring.RecurringLimits(min_occurrences=3, amount_cv_max=1.5, mad_max_days=9)
    as_of = date(2026, 6, 5)
    want = recurring.detect_recurring(ledger, as_of, limits)
    parts = [ledger.filter(F.pmod("batch_ord", F.lit(3)) == i) for i in range(3)]
    maps, amounts = rhythm.month_maps(parts[2]), rhythm.month_amounts(parts[2])
    for part in (parts[0], parts[1], parts[1].limit(0)):
        maps = rhythm.merged_maps(rhythm.month_maps(part), maps)
        amounts = rhythm.merged_amounts(rhythm.month_amounts(part), amounts)
    got = rhythm.recurring_from_maps(maps, amounts, as_of, limits)
    assert want.count() >= 2 and {"RENT CO", "PAPER"} <= {r.merchant_key for r in got.collect()}
    assert rows_of(got, *want.columns) == rows_of(want)
    assert rows_of(maps, *maps.columns) == rows_of(rhythm.month_maps(ledger), *maps.columns)


def test_state_is_small_and_is_all_that_is_read(spark, tmp_path):
    ledger = ledger_rows(spark)
    rhythm.month_maps(ledger).write.parquet(str(tmp_path / "maps"))
    rhythm.month_amounts(ledger).write.parquet(str(tmp_path / "amounts"))
    maps, amounts = (spark.read.parquet(str(tmp_path / t)) for t in ("maps", "amounts"))
    found = rhythm.recurring_from_maps(maps, amounts, date(2026, 6, 20))
    assert all("/maps/" in f or "/amounts/" in f for f in found.inputFiles())
    assert maps.count() < ledger.count() and max(r.days for r in maps.collect()) < 1 << 31
