import json
from datetime import datetime

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.config import Policy, Rule
from ledgerloom.operators import categorize as cat
from ledgerloom.operators import labels, merchants
from ledgerloom.sources.tables import read_table
from ledgerloom.streaming import jobs, windows

RULES = [Rule("BIKE FOOD", "FoodDelivery")]
FOOD = [Policy("food", 15_000, bucket="FoodDelivery")]


def record(day, amount, ref=None, name="Bike Food", **more):
    return dict(account_id="u", entry_reference=ref, booking_date=day, credit_debit_indicator="DBIT",
                transaction_amount=dict(amount=amount, currency="EUR"), creditor=dict(name=name), **more)


def drop(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


@pytest.fixture()
def home(tmp_path):
    return jobs.Paths(str(tmp_path / "tables")), tmp_path / "inbox"


def ingest(spark, home):
    jobs.start_ingest(spark, str(home[1]), home[0]).awaitTermination()
    return read_table(spark, home[0].ledger, schema.LEDGER)


def categorize_with_rules(ledger):
    return cat.categorized(ledger, cat.categorize(merchants.build_merchants(ledger), None, RULES))


def alert(spark, home):
    jobs.start_alerts(spark, home[0], categorize_with_rules, FOOD).awaitTermination()
    return read_table(spark, home[0].alert_log, schema.ALERT_LOG)


def test_ingest_is_incremental_and_idempotent(spark, home):
    twins = [record("2026-07-01", "3.50"), record("2026-07-01", "3.50"), record("2026-07-02", "9.00", "R1")]
    bad = record("2026-07-03", "1.00")
    bad["credit_debit_indicator"] = None
    drop(home[1], "a.json", [*twins, bad, record("2026-07-04", "x")])
    assert ingest(spark, home).count() == 3
    held = read_table(spark, home[0].quarantine, schema.QUARANTINE)
    assert rows_of(held, "reason") == [("bad_amount",), ("no_direction",)]
    drop(home[1], "b.json", [*twins, bad, record("2026-06-30", "4.00", "R2")])  # the overlap again, and one new row
    ledger = ingest(spark, home)
    assert ledger.count() == 4 and ledger.select("id").distinct().count() == 4
    assert read_table(spark, home[0].quarantine, schema.QUARANTINE).count() == 2
    assert set(r[0] for r in ledger.select("booking_month").collect()) == {"2026-06", "2026-07"}


def test_a_replayed_batch_changes_nothing(spark, home):
    from ledgerloom.sources.feed import read_feed

    drop(home[1], "a.json", [record("2026-07-01", "3.50")] * 3)
    for _ in range(2):
        jobs.ingest_batch(read_feed(spark, str(home[1])), home[0])
    assert read_table(spark, home[0].ledger, schema.LEDGER).count() == 3


def test_alerts_once_each_with_late_rows_in_place(spark, home):
    drop(home[1], "a.json", [record("2026-07-01", "90.00", "R1"), record("2026-07-05", "80.00", "R5")])
    ingest(spark, home)
    assert rows_of(alert(spark, home), "subject_id") == [("R5",)]
    drop(home[1], "b.json", [record("2026-07-02", "70.00", "R2"), record("2026-06-30", "200.00", "R0")])
    ingest(spark, home)
    log = alert(spark, home)
    assert rows_of(log, "subject_id") == [("R0",), ("R2",), ("R5",)]
    assert "€160.00" in log.filter("subject_id = 'R2'").first().text
    fresh = read_table(spark, home[0].ledger, schema.LEDGER)
    for _ in range(2):  # the last batch evaluated once more after a crash
        jobs.alert_batch(fresh, 1, home[0], categorize_with_rules, FOOD)
    assert rows_of(read_table(spark, home[0].alert_log, schema.ALERT_LOG), "subject_id") == [("R0",), ("R2",), ("R5",)]


def test_first_run_can_start_from_a_baseline(spark, home):
    drop(home[1], "a.json", [record("2026-07-01", "900.00", "R1")])
    ingest(spark, home)
    jobs.baseline_alerts(spark, home[0]).awaitTermination()
    assert alert(spark, home).count() == 0
    drop(home[1], "b.json", [record("2026-07-02", "1.00", "R2")])
    ingest(spark, home)
    assert rows_of(alert(spark, home), "subject_id") == [("R2",)]


def test_label_stream(spark, home):
    def event(n, actor, category, minute):
        return dict(event_id=n, actor_id=actor, scope="merchant", merchant_key="SHOP", category=category,
                    ts=f"2026-07-01T09:{minute:02d}:00")

    actors = spark.createDataFrame([("owner",)], "actor_id string")
    drop(home[1], "a.json", [event("1", "owner", "Gifts", 1), event("1", "owner", "Gifts", 1), event("2", "guest", "Cash", 5)])
    jobs.start_labels(spark, str(home[1]), actors, home[0]).awaitTermination()
    drop(home[1], "b.json", [event("1", "owner", "Fees", 9), event("3", "owner", "Travel", 4)])
    jobs.start_labels(spark, str(home[1]), actors, home[0]).awaitTermination()
    events = read_table(spark, home[0].label_events, schema.LABEL_EVENTS)
    assert rows_of(events, "event_id") == [("1",), ("3",)]
    assert labels.latest_labels(events).first().category == "Travel"


def test_label_events_with_bounded_state(spark, home):
    """Over restarts: each id once, the latest event decides, replays change nothing, and old ids leave the state."""
    def event(n, actor, category, minute, day=1):
        return dict(event_id=n, actor_id=actor, scope="merchant", merchant_key="SHOP", category=category, ts=f"2026-07-{day:02d}T09:{minute:02d}:00")

    actors = spark.createDataFrame([("owner",)], "actor_id string")

    def run():
        query = jobs.start_bounded_labels(spark, str(home[1]), actors, home[0], "1 day", F.col("ts"))
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    drop(home[1], "a.json", [event("1", "owner", "Gifts", 1), event("1", "owner", "Gifts", 1), event("2", "guest", "Cash", 5)])
    run()
    drop(home[1], "b.json", [event("1", "owner", "Fees", 9), event("3", "owner", "Travel", 4)])
    run()
    raw = read_table(spark, home[0].label_log, schema.LABEL_LOG)
    assert rows_of(raw, "event_id") == [("1",), ("3",)]
    batch = spark.createDataFrame(raw.filter("event_id = '3'").collect(), raw.schema)
    for _ in range(2):  # the last batch once more, after a crash
        jobs.write_table(batch, home[0].label_log, "overwrite", ["stream_batch"])
    events = jobs.stored_labels(spark, home[0])
    assert rows_of(events, "event_id", "category") == [("1", "Gifts"), ("3", "Travel")]
    assert labels.latest_labels(events).first().category == "Travel"
    sizes = []
    for day in range(4, 16, 2):
        drop(home[1], f"d{day}.json", [event(f"{day}-{i}", "owner", "Cash", i, day) for i in range(20)])
        sizes += run()
    assert max(sizes) <= 60 and jobs.stored_labels(spark, home[0]).count() == 2 + 6 * 20
    drop(home[1], "z.json", [event("15-late", "owner", "Rent", 1, 15), event("14-3", "owner", "Rent", 59, 15)])
    run()
    events = jobs.stored_labels(spark, home[0])
    assert events.filter("event_id = '14-3'").first().category == "Cash" and events.count() == 2 + 6 * 20 + 1


def test_stream_windows_equal_the_batch_form(spark, tmp_path):
    rows = [("u", datetime(2026, 7, d, 12), -100 * d, "Other", f"i{d}") for d in range(1, 11)]
    df = spark.createDataFrame(rows, "account_id string, booking_ts timestamp, amount_cents long, category string, id string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    flush = spark.createDataFrame([("u", datetime(2026, 9, 1), -1, "Other", "z")], df.schema)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, make in {"daily": windows.daily_spend_stream, "weekly": windows.weekly_spend_stream}.items():
        make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(
            availableNow=True).option("checkpointLocation", str(tmp_path / f"c-{name}")).start().awaitTermination()
        closed = rows_of(spark.table(name))
        assert set(closed) <= set(rows_of(make(df)))
    assert len(rows_of(windows.weekly_spend_stream(df))) == 16
    flush.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    windows.daily_spend_stream(stream).writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c2")).start(str(tmp_path / "out")).awaitTermination()
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(windows.daily_spend_stream(df))


def test_stream_dedupe(spark, tmp_path):
    rows = [("a", datetime(2026, 7, 1)), ("a", datetime(2026, 7, 2)), ("b", datetime(2026, 7, 2))]
    df = spark.createDataFrame(rows, "id string, booking_ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = windows.dedupe_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert rows_of(spark.table("once"), "id") == rows_of(windows.dedupe_stream(df), "id") == [("a",), ("b",)]


def test_once_per_period(spark):
    due = spark.createDataFrame([("u", datetime(2026, 7, 13).date()), ("v", datetime(2026, 7, 13).date())], "account_id string, as_of date")
    log = spark.createDataFrame([("u", "plan", "2026-W29"), ("v", "plan", "2026-W28"), ("v", "daily", "2026-W29")],
                                "account_id string, kind string, period_key string")
    assert rows_of(windows.once_per(due, "plan", "week", log), "account_id") == [("v",)]
    assert windows.once_per(due, "plan", "day", log).count() == 2
    with pytest.raises(ValueError):
        windows.period_key(F.lit(None), "year")


# ── complete loads ──

def test_statements_load_once_beside_the_feed(spark, tmp_path):
    """A statement file that overlaps the feed: clipped, stored, quarantined and audited in one load, and again."""
    from ledgerloom import schema
    from ledgerloom.sources.tables import read_table

    paths = jobs.Paths(str(tmp_path / "db"))
    (tmp_path / "feed").mkdir()
    record = {"account_id": "P9", "booking_date": "2031-05-10", "transaction_amount": {"amount": "3.00"}, "credit_debit_indicator": "DBIT"}
    (tmp_path / "feed" / "a.json").write_text(json.dumps(record) + "\n" + json.dumps(record | {"account_id": None}) + '\n{"account_id": "P9", "boo')
    jobs.start_ingest(spark, str(tmp_path / "feed"), paths).awaitTermination()
    cursor = jobs.source_cursor(spark, paths).first()
    assert (cursor.account_id, str(cursor.high_water), str(cursor.coverage_start)) == ("P9", "2031-05-10", "2031-05-10")
    held = read_table(spark, paths.quarantine, schema.QUARANTINE)
    assert sorted(r.reason for r in held.collect()) == ["no_account", "unreadable"]
    (tmp_path / "statements").mkdir()
    (tmp_path / "statements" / "s.csv").write_text(
        "Account,Date,Debit,Credit,Description\n" + "".join(f"P9,2031-05-{d},4.00,,MILL\n" for d in ("08", "08", "09", "10", "11", "xx")))
    for new, duplicate in ((3, 0), (0, 3)):
        jobs.load_statements(spark, str(tmp_path / "statements"), paths)
        audit = read_table(spark, paths.ingest_audit, schema.INGEST_AUDIT).orderBy("loaded_at", ascending=False).first()
        assert (audit.submitted, audit.new, audit.duplicate, audit.clipped, audit.quarantined) == (3, new, duplicate, 2, 1)
    assert read_table(spark, paths.ledger, schema.LEDGER).count() == 4
    assert read_table(spark, paths.quarantine, schema.QUARANTINE).count() == 3


def test_bill_alerts_are_written_once_for_bill_due_and_kind(spark, ledger_of, tmp_path):
    from datetime import date

    from ledgerloom import schema
    from ledgerloom.config import Bill
    from ledgerloom.sources.tables import read_table

    paths = jobs.Paths(str(tmp_path / "db"))
    ledger, accounts = ledger_of([("2031-01-01", "MOSS", -5, "Other")]), spark.createDataFrame([("a1",), ("b2",)], "account_id string")
    bills = [Bill("Water", "^TIDE", 9, 6_000, 10)]
    for day in (date(2031, 5, 20), date(2031, 5, 21), date(2031, 5, 21), date(2031, 6, 20)):
        jobs.send_bill_alerts(ledger, bills, day, paths, accounts)
    log = read_table(spark, paths.bill_log, schema.ALERT_LOG)
    assert sorted((r.account_id, r.kind, r.period_key) for r in log.collect()) == sorted(
        (a, "bill_late", f"Water|{due}|late") for a in ("a1", "b2") for due in ("2031-05-09", "2031-06-09"))
