"""Pay cycles: properties of the calendar, and budgets recomputed from drawn bookings."""

import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from ledgerloom.operators import cycle

POOL = 345_600


@pytest.fixture(scope="module")
def accounts(spark):
    return spark.createDataFrame([("a1",)], "account_id string")


def reported(spark, texts, as_of, payday):
    rows = [("a1", text, datetime(2031, 1, 1, 6, i)) for i, text in enumerate(texts)]
    return cycle.log_paydays(spark.createDataFrame(rows, "account_id string, text string, ts timestamp"), as_of, payday)


def around(accounts, as_of, payday, overrides=None):
    row, = cycle.cycles_around(accounts, as_of, payday, overrides).collect()
    return row


@pytest.mark.parametrize("payday", [1, 9, 28, 30, 31])
def test_every_day_lies_in_its_own_scheduled_cycle(accounts, payday):
    rng = random.Random(payday)
    for _ in range(6):
        day = date(2031, 1, 1) + timedelta(days=rng.randrange(800))
        got = around(accounts, day, payday)
        assert got.cycle_start <= day < got.next_payday and got.cycle_source == "scheduled"
        assert got.days_left == (got.next_payday - day).days
        for edge in (got.cycle_start, got.next_payday):
            assert edge.day == payday or (edge + timedelta(days=1)).day == 1 and edge.day < payday
        assert 28 <= (got.next_payday - got.cycle_start).days <= 31


def test_a_report_moves_its_month_only(spark, accounts):
    paid = date(2031, 10, 7)
    log = reported(spark, [paid.isoformat()], date(2031, 10, 8), 9)
    for day, start, end, source in (
            (date(2031, 10, 7), paid, date(2031, 11, 9), "logged"), (date(2031, 10, 6), date(2031, 9, 9), paid, "scheduled"),
            (date(2031, 11, 9), date(2031, 11, 9), date(2031, 12, 9), "scheduled")):
        got = around(accounts, day, 9, log)
        assert (got.cycle_start, got.next_payday, got.cycle_source) == (start, end, source)


def test_the_latest_report_counts_and_nonsense_does_not(spark, accounts):
    texts = ["2031-10-05", "soon", "2031-10-41", "07.10.2031", "2031-10-12"]
    log = reported(spark, texts, date(2031, 10, 20), 9)
    assert around(accounts, date(2031, 10, 20), 9, log).cycle_start == date(2031, 10, 12)
    assert reported(spark, texts[1:4], date(2031, 10, 20), 9).count() == 0


def test_a_report_belongs_to_the_nearest_payday(spark):
    rng = random.Random(6)
    for payday in (1, 9, 23, 31):
        days = [date(2031, 1, 1) + timedelta(days=rng.randrange(700)) for _ in range(40)]
        df = spark.createDataFrame([(d,) for d in days], "d date")
        got = df.select("d", cycle.cycle_month_of(F.col("d"), payday).alias("m")).collect()
        for r in got:
            first = r.d.replace(day=1)
            firsts = [(first - timedelta(days=1)).replace(day=1), first, (first + timedelta(days=32)).replace(day=1)]

            def planned(first):
                last = (first + timedelta(days=31)).replace(day=1) - timedelta(days=1)
                return first.replace(day=min(payday, last.day))

            assert abs((planned(r.m) - r.d).days) == min(abs((planned(f) - r.d).days) for f in firsts)


def test_every_day_has_one_cycle(spark, accounts):
    calendar = cycle.payday_calendar(accounts, date(2030, 12, 1), date(2031, 12, 1), 31)
    log = reported(spark, ["2031-03-02", "2031-08-29"], date(2031, 9, 1), 31)
    table = cycle.cycles(cycle.apply_overrides(calendar, log))
    days = accounts.select("account_id", F.explode(F.sequence(
        F.lit(date(2031, 1, 1)), F.lit(date(2031, 11, 30)), F.expr("interval 1 day"))).alias("day"))
    placed = cycle.cycle_for(days, "day", table)
    assert placed.count() == days.count() == placed.select("day").distinct().count()


def test_budget_is_the_pool_less_what_the_cycle_took(spark, ledger_of, accounts):
    rng = random.Random(77)
    kinds = ["Groceries", "FoodDelivery", "Gifts", "Rent", "Income", "Transfers", "Uncategorized"]
    rows = [((date(2031, 9, 20) + timedelta(days=rng.randrange(40))).isoformat(), "QUAY", rng.choice([-1, -1, 1]) * rng.randrange(1, 30_000),
             rng.choice(kinds)) for _ in range(150)]
    df = ledger_of(rows)
    log = reported(spark, ["2031-10-07"], date(2031, 10, 8), 9)
    for as_of, overrides in ((date(2031, 10, 20), None), (date(2031, 10, 20), log), (date(2031, 10, 9), None), (date(2031, 9, 30), None)):
        for keys in (["account_id"], []):
            got = cycle.account_status(df, as_of, POOL, 9, overrides if keys else None, keys=keys, threshold=20_000).first()
            mine = [(c, k) for d, _, c, k in rows if got.cycle_start.isoformat() <= d <= as_of.isoformat()]
            held = [c for c, k in mine if k == "Uncategorized" and c >= 20_000]
            took = -sum(c for c, k in mine if k in ("Groceries", "FoodDelivery", "Gifts") or k == "Uncategorized" and c < 20_000)
            assert (got.discretionary_cents, got.remaining_cents) == (took, POOL - took)
            assert got.safe_today_cents == max(0, (POOL - took) // got.days_left)
            assert (got.inflow_count, got.inflow_cents) == (len(held), sum(held))
            assert got.net_fixed_cents == -sum(c for c, k in mine if k == "Rent")


def test_silent_accounts_keep_the_whole_pool(spark, ledger_of):
    two = spark.createDataFrame([("a1",), ("hush",)], "account_id string")
    df = ledger_of([("2031-10-10", "QUAY", -POOL - 1, "Groceries")])
    status = cycle.account_status(df, date(2031, 10, 12), POOL, 9, accounts=two)
    got = {r.account_id: r for r in cycle.weekly_plan(status).collect()}
    assert (got["a1"].safe_today_cents, got["a1"].remaining_cents, got["a1"].light) == (0, -1, "red")
    hush = got["hush"]
    assert (hush.remaining_cents, hush.weeks_left, hush.light) == (POOL, -(-hush.days_left // 7), "green")
    assert hush.week_budget_cents == POOL // hush.weeks_left and hush.weekly_rail_cents == POOL * 12 // 52


def test_light_changes_beyond_its_limits(spark):
    df = spark.createDataFrame([(c,) for c in (71, 70, 40, 39)], "c long")
    assert [r[0] for r in df.select(cycle.status_light(F.col("c"), 70, 40)).collect()] == ["green", "amber", "amber", "red"]


def test_reports_are_kept_by_account(spark):
    rows = [("p", "2031-10-05", datetime(2031, 10, 5)), ("q", "2031-10-11", datetime(2031, 10, 11))]
    log = cycle.log_paydays(spark.createDataFrame(rows, "account_id string, text string, ts timestamp"), date(2031, 10, 12), 9)
    assert rows_of(log, "account_id", "cycle_month", "actual_date") == [
        ("p", date(2031, 10, 1), date(2031, 10, 5)), ("q", date(2031, 10, 1), date(2031, 10, 11))]
