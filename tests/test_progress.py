"""Kept running totals: equal to the full recompute, however rows are dealt to batches, and safe to run again."""

import json
import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.config import Policy, Rule
from ledgerloom.operators import policy, progress
from ledgerloom.operators.categorize import categorize, categorized
from ledgerloom.sources.tables import read_table
from ledgerloom.streaming import jobs

CAPS = [Policy("food", 10_000, bucket="Groceries"), Policy("name", 4_000, pattern="SHOP|TEA"), Policy("all", 90_000, bucket="Other")]
RULES = [Rule("FOOD", "Groceries")]


def made_rows(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(f"t{i}", rng.choice(["a", "b", None]), f"2026-0{rng.randint(6, 7)}-{rng.randint(1, 9):02d}", rng.randint(-5000, 1500),
             rng.choice(["FOOD", "TEA SHOP", "OTHER", None]), rng.choice(["Groceries", "Other", "Uncategorized", "Rent"]), i % 4, i) for i in range(n)]
    return spark.createDataFrame(rows, "id string, account_id string, day string, amount_cents long, merchant_key string, category string, load int, batch_ord long").select(
        "id", "account_id", F.to_date("day").alias("booking_date"), "amount_cents", F.col("merchant_key").alias("merchant_raw"), "merchant_key", "category",
        F.concat(F.lit("load"), "load").alias("batch_id"), "batch_ord")


@pytest.mark.parametrize("hot_rows, block_rows", [(1 << 22, 1 << 20), (1, 7)])
@pytest.mark.parametrize("keys", [["account_id"], []])
def test_loads_one_by_one_equal_the_recompute(spark, keys, hot_rows, block_rows):
    rows = made_rows(spark)
    if keys == []:
        rows = rows.drop("account_id")
    state, seen = progress.progress_sums(rows.limit(0), CAPS, keys), None
    for load in range(4):
        fresh = rows.filter(F.col("batch_id") == f"load{load}")
        seen = fresh if seen is None else seen.unionByName(fresh)
        new = fresh.select("id")
        options = dict(keys=keys, hot_rows=hot_rows, block_rows=block_rows)
        want = policy.policy_alerts(seen, CAPS, new_ids=new, **options)
        got = progress.alerts_from_state(fresh, state, CAPS, **options)
        assert rows_of(got, *want.columns) == rows_of(want, *want.columns) and got.count() > 0
        state = spark.createDataFrame(progress.merged_sums(state, progress.progress_sums(fresh, CAPS, keys), keys=keys).collect(), state.schema)
    whole = progress.progress_sums(rows, CAPS, keys)
    assert rows_of(state, *whole.columns) == rows_of(whole, *whole.columns)


def test_only_touched_months_of_the_state_are_taken(spark, tmp_path):
    rows = made_rows(spark)
    progress.progress_sums(rows.filter("batch_id = 'load0'"), CAPS).write.parquet(str(tmp_path / "s"))
    got = progress.alerts_from_state(rows.filter("batch_id = 'load1'"), spark.read.parquet(str(tmp_path / "s")), CAPS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def record(day, amount, ref):
    return {"account_id": "A1", "entry_reference": ref, "booking_date": day, "transaction_amount": {"amount": amount},
            "credit_debit_indicator": "DBIT", "status": "BOOK", "creditor": {"name": "FOOD HALL"}}


@pytest.fixture
def home(tmp_path):
    (tmp_path / "feed").mkdir()
    return jobs.Paths(str(tmp_path / "db")), tmp_path / "feed"


def sort_out(ledger):
    dims = ledger.filter(F.col("merchant_key").isNotNull()).select("merchant_key").distinct()
    return categorized(ledger, categorize(dims, None, RULES))


def load(spark, home, name, *records):
    (home[1] / name).write_text("\n".join(map(json.dumps, records)))
    jobs.start_ingest(spark, str(home[1]), home[0]).awaitTermination()


def alert(spark, home, **options):
    jobs.start_kept_alerts(spark, home[0], sort_out, CAPS, **options).awaitTermination()
    return rows_of(read_table(spark, home[0].alert_log, schema.ALERT_LOG), "subject_id")


def test_stream_alerts_late_rows_in_place_and_replays_change_nothing(spark, home):
    load(spark, home, "a.json", record("2026-07-01", "60.00", "R1"), record("2026-07-05", "50.00", "R5"))
    assert alert(spark, home) == [("R5",)]
    assert alert(spark, home) == [("R5",)]  # nothing new
    load(spark, home, "b.json", record("2026-07-02", "45.00", "R2"), record("2026-06-30", "101.00", "R0"))
    assert alert(spark, home) == [("R0",), ("R2",), ("R5",)]
    log = read_table(spark, home[0].alert_log, schema.ALERT_LOG)
    assert "€105.00" in log.filter("subject_id = 'R2'").first().text
    sums = read_table(spark, home[0].policy_sums, schema.POLICY_SUMS)
    before, ledger = rows_of(sums), read_table(spark, home[0].ledger, schema.LEDGER)
    fresh = ledger.join(sums.filter("stream_batch = 1").select("batch_id").distinct(), "batch_id", "left_semi")
    for _ in range(2):  # the last batch once more, after a crash
        jobs.kept_alert_batch(fresh, 1, home[0], sort_out, CAPS)
    assert rows_of(read_table(spark, home[0].policy_sums, schema.POLICY_SUMS)) == before
    assert rows_of(read_table(spark, home[0].alert_log, schema.ALERT_LOG), "subject_id") == [("R0",), ("R2",), ("R5",)]
    load(spark, home, "c.json", record("2026-07-03", "1.00", "R3"), record("2026-06-29", "1.00", "R9"))
    assert alert(spark, home) == [("R0",), ("R2",), ("R3",), ("R5",)]
    assert "€106.00" in read_table(spark, home[0].alert_log, schema.ALERT_LOG).filter("subject_id = 'R3'").first().text


def test_silent_first_run_and_rebuilt_months(spark, home):
    load(spark, home, "a.json", record("2026-07-01", "900.00", "R1"), record("2026-06-01", "5.00", "R2"))
    assert alert(spark, home, silent=True) == []
    load(spark, home, "b.json", record("2026-07-02", "1.00", "R3"))
    assert alert(spark, home) == [("R3",)]

    def other(ledger):  # a correction: food is rent
        return sort_out(ledger).withColumn("category", F.when(F.col("category") == "Groceries", "Rent").otherwise(F.col("category")))

    jobs.rebuild_sums(spark, home[0], other, CAPS, ["2026-07"])
    sums = read_table(spark, home[0].policy_sums, schema.POLICY_SUMS)
    assert rows_of(sums.filter("cents > 0"), "booking_month", "cents") == [("2026-06", 500)]
    load(spark, home, "c.json", record("2026-07-03", "2.00", "R4"))
    assert alert(spark, home) == [("R3",)]
