"""Caps and bills over drawn bookings, held against the definitions told in plain Python."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.config import Bill, Policy
from ledgerloom.operators import bills, ingest, policy
from ledgerloom.plans.shapes import block_of, not_stored, running_totals

CAPS = [Policy("lanterns", 21_000, pattern="^LANTERN"), Policy("meals", 9_000, bucket="FoodDelivery"),
        Policy("gifts", 4_000, sub_label="Gifts")]
HOLD = 30_000


def drawn(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        day = date(2032, 1, 25) + timedelta(days=rng.randrange(45))
        cents = rng.choice([-1, -1, -1, 1]) * rng.randrange(1, 4_000) * rng.choice([1, 1, 12])
        rows.append((day.isoformat(), rng.choice(["LANTERN INN", "TIDE", "Lantern Co"]), cents,
                     rng.choice(["FoodDelivery", "Gifts", "Uncategorized", "Rent"])))
    return rows


def expected(rows, caps=CAPS, hold=HOLD):
    """(row, policy, month to date, charge number) of every row over the cap of its first policy."""
    def matches(cap, name, kind):
        if cap.pattern:
            return name.upper().startswith("LANTERN")
        return kind == (cap.sub_label or "FoodDelivery")

    kept = [(d, i, n, c, k) for i, (d, n, c, k) in enumerate(rows) if not (k == "Uncategorized" and c >= hold)]
    for place, cap in enumerate(caps):
        total, charges = defaultdict(int), defaultdict(int)
        for d, i, name, cents, kind in sorted(kept):
            if not matches(cap, name, kind):
                continue
            total[d[:7]] -= cents
            charges[d[:7]] += cents < 0
            first = next(p for p, c in enumerate(caps) if matches(c, name, kind)) == place
            if first and cents < 0 and total[d[:7]] > cap.cap_monthly_cents:
                yield f"t-{i}", cap.name, total[d[:7]], charges[d[:7]]


def fired(df, **options):
    return rows_of(policy.policy_alerts(df, CAPS, threshold=HOLD, **options), "id", "policy", "mtd_cents", "charge_number")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("cut", [{}, {"block_rows": 3, "hot_rows": 2}])
def test_alerts_equal_the_definition(ledger_of, seed, cut):
    rows = drawn(seed)
    want = sorted(expected(rows), key=repr)
    assert fired(ledger_of(rows), **cut) == want and len(want) > 10


def test_one_month_and_new_rows_only(ledger_of, spark):
    rows = drawn(3)
    df, everything = ledger_of(rows), sorted(expected(rows), key=repr)
    assert fired(df, as_of=date(2032, 2, 3)) == [a for a in everything if rows[int(a[0][2:])][0].startswith("2032-02")]
    some = {a[0] for a in everything[::3]} | {"t-0"}
    got = fired(df, new_ids=spark.createDataFrame([(i,) for i in some], "id string"))
    assert got == [a for a in everything if a[0] in some]


def test_alert_text_names_the_amounts(ledger_of):
    row = policy.policy_alerts(ledger_of([("2032-02-02", "Lantern Inn { x }", -2_100_050, "Other")]), CAPS).first()
    assert row.text == ("Lantern Inn: €21,000.50, 1st charge this month. lanterns stands at €21,000.50 against a cap of "
                        "€210.00; that is €252,006.00 a year.")


# ── running totals ──

@pytest.mark.parametrize(("block_rows", "hot_rows"), [(1, 0), (7, 0), (7, 110), (7, 1_000), (1_000_000, 0)])
def test_running_totals_do_not_depend_on_the_cut(spark, block_rows, hot_rows):
    df = spark.range(300).select(  # group 0 has 200 rows, group 1 has 100
        F.when(F.col("id") % 3 == 2, 0).otherwise(F.col("id") % 3).alias("k"), F.expr("id div 100").alias("day"), F.col("id").alias("pos"),
        ((F.col("id") * 37) % 11 - 5).alias("v")).withColumn("block", block_of(F.col("pos"), block_rows))
    sums = {"s": F.col("v"), "n": F.when(F.col("v") < 0, 1).otherwise(0)}
    got = running_totals(df, ["k"], ["day", "block"], ["pos"], sums, hot_rows)
    whole = Window.partitionBy("k").orderBy("day", "pos").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("pos", F.sum("v").over(whole).alias("s"), F.sum(F.when(F.col("v") < 0, 1).otherwise(0)).over(whole).alias("n"))
    assert rows_of(got, "pos", "s", "n") == rows_of(want)


@pytest.mark.parametrize("column", ["account_id", "batch_id", "booking_date", "merchant_raw", "batch_ord"])
def test_a_null_in_any_column_changes_nothing_when_groups_are_cut(ledger_of, column):
    """Alerts and ids of rows of which a third, or all, lack the column: the cut form equals the plain one."""
    base = ledger_of([("2032-02-02", "LANTERN INN", -700, "Other")] * 120)
    for missing in (F.lit(True), F.col("batch_ord") % 3 == 0):
        df = base.withColumn(column, F.when(~missing, F.col(column)))
        assert fired(df, block_rows=8, hot_rows=5) == fired(df)
        bare = df.withColumn("id", F.lit(None).cast("string"))
        cut, plain = (ingest.assign_ids(bare, **o).select("id") for o in ({"block_rows": 8, "hot_rows": 5}, {}))
        assert rows_of(cut) == rows_of(plain)
        if column != "batch_ord":
            assert ingest.assign_ids(bare, block_rows=8, hot_rows=5).count() == 120
    everyone = base.withColumn("batch_id", F.lit(None).cast("string")).withColumn("id", F.lit(None).cast("string"))
    assert ingest.assign_ids(everyone, block_rows=8, hot_rows=5).select("id").distinct().count() == 120


# ── what is new, what was sent ──

def test_batches_are_new_by_load_time_whatever_their_files_are_called(spark, ledger_of):
    early = ingest.to_ledger(_stored(ledger_of, "z-last.json"), F.lit("2032-03-01 08:00:00").cast("timestamp"))
    late = ingest.to_ledger(_stored(ledger_of, "a-first.json"), F.lit("2032-03-02 08:00:00").cast("timestamp"))
    both, mark = early.unionByName(late), early.first().batch_id
    assert rows_of(policy.new_since(both, mark), "batch_id") == [(late.first().batch_id,)]
    assert policy.new_since(both, None).count() == 0


def _stored(ledger_of, file):
    names = "value_date date, currency string, description string, source string"
    extra = {part.split()[0]: F.lit(None).cast(part.split()[1]) for part in names.split(", ")}
    return ledger_of([("2032-02-28", "TIDE", -5, "Other")]).withColumns(extra | {"batch_id": F.lit(file)})


def test_only_what_the_log_lacks_is_sent(spark):
    kind = "kind string, subject_id string, note string"
    alerts = spark.createDataFrame([("cap", "7", "x"), ("cap", "8", "y"), ("bill", "7", "z")], kind)
    log = spark.createDataFrame([("cap", "7", "old"), ("cap", "7", "older"), ("cap", "99", "q")], kind)
    assert rows_of(policy.unsent(alerts, log)) == [("bill", "7", "z"), ("cap", "8", "y")]


def test_a_large_store_is_not_shuffled_for_a_small_batch(spark, tmp_path):
    spark.range(50_000).selectExpr("cast(id AS string) AS id", "id AS other").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([("7",), ("new",)], "id string").write.parquet(str(tmp_path / "n"))
    new = spark.read.parquet(str(tmp_path / "n"))
    df = not_stored(new, spark.read.parquet(str(tmp_path / "s")), ["id"])
    assert rows_of(df) == [("new",)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index(f"{tmp_path}/s]")]
    assert above.rindex("LeftSemi") > above.rindex("Exchange hashpartitioning")


# ── bills ──

BILLS = [Bill("Water", "^TIDE", 9, 6_000, 10), Bill("Light", "LANTERN", 31, 2_500, 0)]


def plain_state(rows, bill, as_of, early, grace):
    """Due date, latest payment in time, and what is to be said about it."""
    month_end = (as_of.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
    due = as_of.replace(day=min(bill.due_day, month_end.day))
    if due > as_of:
        last = as_of.replace(day=1) - timedelta(days=1)
        due = last.replace(day=min(bill.due_day, last.day))
    word = bill.pattern.lstrip("^")
    paid = [(date.fromisoformat(d), i, -c) for i, (d, n, c, _) in enumerate(rows)
            if c < 0 and due - timedelta(days=early) <= date.fromisoformat(d) <= as_of
            and (n.upper().startswith(word) if bill.pattern[0] == "^" else word in n.upper())]
    if not paid:
        return due, None, "late" if (as_of - due).days > grace else None
    cents = max(paid)[2]
    return due, cents, "drift" if abs(cents - bill.expected_cents) * 100 > bill.tolerance_pct * bill.expected_cents else None


@pytest.mark.parametrize("seed", range(4))
def test_bill_alerts_equal_the_definition(ledger_of, seed):
    rng = random.Random(40 + seed)
    rows = [((date(2032, 1, 20) + timedelta(days=rng.randrange(60))).isoformat(), rng.choice(["TIDE WATER", "LANTERN INN", "MOSS"]),
             -rng.choice([2_500, 6_000, 6_600, 6_601, 2_501]), "Utilities") for _ in range(12)]
    df = ledger_of(rows)
    for as_of in (date(2032, 2, 14), date(2032, 3, 2), date(2032, 3, 20)):
        got = {(a.bill, a.due, a.kind) for a in bills.bill_alerts(bills.bill_state(df, BILLS, as_of, early_days=5, grace_days=3)).collect()}
        want = set()
        for bill in BILLS:
            due, _, kind = plain_state(rows, bill, as_of, 5, 3)
            if kind:
                want.add((bill.name, due, kind))
        assert got == want


def test_due_dates_agree_in_both_forms(spark):
    rng = random.Random(8)
    cases = [(date(2030, 1, 1) + timedelta(days=rng.randrange(1_500)), rng.randint(1, 31)) for _ in range(200)]
    df = spark.createDataFrame(cases, "d date, n int")
    for r in df.select("d", "n", bills.current_due(F.col("d"), F.col("n")).alias("due")).collect():
        assert r.due == bills.due_on_or_before(r.d, r.n)
