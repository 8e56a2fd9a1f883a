"""Ids in slots: a batch reads few of them, and no loss between two writes stores a row twice or drops one."""

import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.sources import idstore
from ledgerloom.sources.feed import read_feed
from ledgerloom.sources.tables import read_table
from ledgerloom.streaming import jobs


def references(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("bank-"), F.col("id").cast("string")).alias("id"))


def test_a_small_batch_reads_few_slots(spark, tmp_path):
    path = str(tmp_path / "ids")
    idstore.write_ids(references(spark, 0, 20_000), path, 1, 64)
    batch = references(spark, 19_998, 20_003)
    near = idstore.stored_near(batch, path, 64)
    assert "PartitionFilters: [slot" in near._jdf.queryExecution().executedPlan().toString()
    read = {r[0] for r in near.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(read) <= 5 < len(spark.read.parquet(path).inputFiles())
    assert near.count() < 20_000 / 8
    assert rows_of(idstore.unstored(batch, path, batch.limit(0), 2, 64)) == [("bank-20000",), ("bank-20001",), ("bank-20002",)]
    assert idstore.unstored(batch.limit(0), path, batch.limit(0), 2, 64).isEmpty()
    assert idstore.unstored(batch, str(tmp_path / "none"), batch.limit(0), 2, 64).count() == 5


def record(day, ref):
    return {"account_id": "A1", "entry_reference": ref, "booking_date": day, "transaction_amount": {"amount": "2.00"},
            "credit_debit_indicator": "DBIT", "status": "BOOK", "creditor": {"name": "SHOP"}}


@pytest.fixture
def home(tmp_path):
    (tmp_path / "feed").mkdir()
    return jobs.Paths(str(tmp_path / "db")), tmp_path / "feed"


def test_second_ingest_adds_nothing(spark, home):
    paths, feed = home
    for name, refs in (("a.json", "ABCA"), ("b.json", "CD"), ("c.json", "AD")):
        (feed / name).write_text("\n".join(json.dumps(record("2026-07-01", r)) for r in refs))
        jobs.start_ingest(spark, str(feed), paths, id_slots=16).awaitTermination()
    assert rows_of(read_table(spark, paths.ledger, schema.LEDGER), "id") == [("A",), ("B",), ("C",), ("D",)]
    ids = read_table(spark, paths.ids, schema.STORED_IDS)
    assert rows_of(ids, "id", "stream_batch") == [("A", 0), ("B", 0), ("C", 0), ("D", 1)]


@pytest.mark.parametrize("lost_after", ["ids", "ledger"])
def test_a_loss_between_the_writes(spark, home, monkeypatch, lost_after):
    paths, feed = home
    (feed / "a.json").write_text("\n".join(json.dumps(record("2026-07-01", r)) for r in "AB"))
    jobs.ingest_batch(read_feed(spark, str(feed)), paths, batch_id=0, id_slots=8)
    (feed / "a.json").write_text("\n".join(json.dumps(record("2026-07-02", r)) for r in "BCD"))
    write, calls = jobs.write_table, []

    def losing(df, path, *args):
        if path == paths.ledger and lost_after == "ids" or path == paths.quarantine and lost_after == "ledger":
            calls.append(path)
            raise RuntimeError("lost")
        write(df, path, *args)

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "write_table", losing)
        with pytest.raises(RuntimeError):
            jobs.ingest_batch(read_feed(spark, str(feed)), paths, batch_id=1, id_slots=8)
    assert calls
    for _ in range(2):
        jobs.ingest_batch(read_feed(spark, str(feed)), paths, batch_id=1, id_slots=8)
    assert rows_of(read_table(spark, paths.ledger, schema.LEDGER), "id") == [("A",), ("B",), ("C",), ("D",)]
