"""Registered queries: physical plans, agreement with SQL, and behaviour under a hot key."""

import math

import duckdb
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.config import Policy
from ledgerloom.operators import ingest, policy, spend
from ledgerloom.plans.catalog import QUERIES
from ledgerloom.plans.oracles import ORACLES
from ledgerloom.plans.shapes import running_totals
from ledgerloom.sources import star

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_hold_at_scale(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "MapInPandas"):
        assert unwanted not in plan


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = plan_of(spend.daily_spend(star.event_ledger(spark, FOLDER), *[d for d in _days()]))
    assert "ReadSchema: struct<ts:" in plan and "props" not in plan


def _days():
    from datetime import date

    return date(2024, 1, 1), date(2024, 1, 25)


def test_stored_ledger_prunes_months(spark, tmp_path):
    star.event_ledger(spark, FOLDER).write.partitionBy("booking_month").parquet(str(tmp_path / "l"))
    stored = spark.read.parquet(str(tmp_path / "l"))
    plan = plan_of(spend.category_pareto(stored, *_days()))
    assert "PartitionFilters: [isnotnull(booking_month" in plan and "PushedFilters: [IsNotNull(booking_date)" in plan


def test_copies_are_pruned_before_the_shuffle(spark):
    rows = star.event_ledger(spark, FOLDER)
    plan = plan_of(ingest.append_new(rows.limit(0), rows))
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["reconciliation", "merchant_pareto", "safe_to_spend", "policy_alerts", "recurring_charges",
                                  "statement_map", "row_ids", "quarantine_rows", "relabel_requests", "weekly_windows"])
def test_results_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)

    def text(row):
        return tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) for v in row)

    assert sorted(map(text, df.select(*names).collect())) == sorted(map(text, result.fetchall()))


def test_a_key_with_a_third_of_all_rows(spark):
    """One account, one day and one merchant dominate; small limits force the split path."""
    rows = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 50)).alias("account_id"),
        F.to_date(F.lit("2026-07-01")).alias("booking_date"), (-(F.col("id") % 7) - 1).alias("amount_cents"),
        F.lit("SHOP").alias("merchant_raw"), F.lit("SHOP").alias("merchant_key"), F.lit("Other").alias("category"),
        F.lit("b").alias("batch_id"), F.col("id").alias("batch_ord"), F.lit(None).cast("string").alias("id"))
    split = ingest.assign_ids(rows, block_rows=100, hot_rows=50)
    assert rows_of(split, "id") == rows_of(ingest.assign_ids(rows), "id")
    caps = [Policy("all", 1_000, bucket="Other")]
    named = split.withColumn("id", F.concat(F.lit("t"), "batch_ord"))
    cut = policy.policy_alerts(named, caps, block_rows=64, hot_rows=100)
    assert rows_of(cut, "id", "mtd_cents", "charge_number") == rows_of(
        policy.policy_alerts(named, caps), "id", "mtd_cents", "charge_number")


def test_cut_groups_are_shuffled_once_by_text(spark):
    """Rows met the sums before their piece in a join that shuffled both anew, by hashes that take more room than what they stand for."""
    rows = spark.createDataFrame([(None, None, 1, None, "a", "x", 0), (None, None, 1, None, "a", "x", 9), (None, None, None, "T", None, None, 4)],
                                 "id string, booking_date date, amount_cents long, merchant_raw string, account_id string, batch_id string, batch_ord long")
    numbered = ingest.assign_ids(rows, block_rows=5, hot_rows=1)
    plan = plan_of(numbered)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("_slot" in line for line in joins)
    assert not any("sha2" in line for line in plan[plan.index("Exchange"):].splitlines())
    assert len({r.id for r in numbered.collect()}) == 3


@pytest.mark.parametrize("hot_rows", [None, 100, 1])
def test_running_totals_with_null_keys_and_blocks(spark, hot_rows):
    df = spark.createDataFrame([(None, 1, 1, 0), (None, 1, 2, 5), (None, 2, 3, 2), (None, None, 0, 1), ("a", 3, 4, 7)],
                               "k string, block long, pos long, v long")
    got = running_totals(df, ["k"], ["block"], ["pos"], {"total": F.col("v"), "n": F.lit(1)}, hot_rows)
    assert rows_of(got, "pos", "n", "total") == [(0, 1, 1), (1, 2, 1), (2, 3, 6), (3, 4, 8), (4, 1, 7)]
