import csv
import hashlib
import io
import random
from datetime import date, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.operators import ingest
from ledgerloom.sources import statements, tables

HEADER = "Posted Account, Posted Transactions Date, Description, Debit Amount, Credit Amount,Balance,Transaction Type\n"


def load(spark, path, account_map=None, clip=None):
    mapped = ingest.map_statements(statements.read_statements(spark, str(path)), account_map or {})
    return mapped if clip is None else ingest.clip_overlap(mapped, clip, [])


def settled(df):
    return rows_of(df, "merchant_raw", "amount_cents", "status", "reason")


def statement_lines(rng, n):
    """Statement lines with what has to become of them, drawn check by check."""
    for i in range(n):
        day, amount = date(2031, 1, 1) + timedelta(days=rng.randrange(300)), rng.randrange(1, 9_000_000)
        debit = rng.random() < 0.7
        text = rng.choice([f"{amount / 100:.2f}", f"{amount / 100:,.2f}"])
        line = {"account": "P9", "date": day.strftime(rng.choice(["%d/%m/%y", "%d/%m/%Y", "%Y-%m-%d"])), "name": f"QUAY {i}",
                "debit": text if debit else "", "credit": "" if debit else text, "type": "Card"}
        cents, status, reason = -amount if debit else amount, "ok", None
        fault = rng.choice([None, None, "pending", "no_amount", "bad_amount", "zero_amount", "no_account", "bad_date"])
        if fault == "pending":
            line["type"], status = rng.choice(["PENDING", "Card authorisation"]), "skip"
        elif fault == "no_amount":
            line["debit"] = line["credit"] = " "
            cents, status = 0, "skip"
        elif fault == "zero_amount":
            line["debit"] = line["credit"] = "0.00"
            cents, status = 0, "skip"
        elif fault == "bad_amount":
            line["debit"], cents, status = text + "1", None, "reject"
        elif fault:
            line["account" if fault == "no_account" else "date"], status = "", "reject"
        reason = fault
        yield line, (line["name"], cents, status, reason)


def written(lines, columns, names):
    out = io.StringIO()
    rows = csv.DictWriter(out, columns, extrasaction="ignore", lineterminator="\n")
    out.write(",".join(names) + "\n")
    rows.writerows(lines)
    return out.getvalue()


def test_every_line_gets_its_verdict(spark, tmp_path):
    lines, wanted = zip(*statement_lines(random.Random(31), 300))
    (tmp_path / "a.csv").write_text(written(lines, ["type", "credit", "account", "name", "date", "debit"], [
        "Type", "CREDIT", " Account ", "description", "Transaction Date", "Debit"]))
    assert settled(load(spark, tmp_path)) == sorted(wanted, key=repr)


def test_layouts_encodings_and_accounts_together(spark, tmp_path):
    """Many files, each with its own columns and one of three encodings, are one table."""
    rng, wanted = random.Random(32), []
    for i in range(40):
        names = {"account": "Masked Account", "date": "date", "name": "Description2", "debit": "debit", "credit": "Credit Amount",
                 "type": "transaction type", "currency": "Currency", "extra": f"Extra {i}"}
        columns = list(names)
        rng.shuffle(columns)
        who, money = f"Brücke № {i}" if i % 3 else f"Brücke “{i}” €", rng.choice(["", "eur", "chf"])
        line = {"account": f"K{i % 2}", "date": "2031-02-03", "name": who, "debit": "7.5", "credit": "", "type": "x", "currency": money,
                "extra": 'a "quoted", cell'}
        encoding = ("cp1252", "utf-8", "utf-8-sig")[i % 3]
        (tmp_path / f"{i}.csv").write_bytes(written([line], columns, [names[c] for c in columns]).encode(encoding))
        wanted.append(("acc" if i % 2 else "K0", who, -750, "foreign_currency" if money == "chf" else None))
    got = load(spark, tmp_path, {"K1": "acc"})
    assert rows_of(got, "account_id", "merchant_raw", "amount_cents", "reason") == sorted(wanted, key=repr)
    table = spark.createDataFrame([("K1", "acc")], "label string, account_id string")
    assert rows_of(load(spark, tmp_path, table), "account_id") == rows_of(got, "account_id")


def test_unknown_header_fails_and_shows_it(spark, tmp_path):
    (tmp_path / "x.csv").write_text("When,What,How much\n1,2,3\n")
    with pytest.raises(Exception, match="How much"):
        load(spark, tmp_path).collect()


def test_thousands_of_layouts_are_one_read(spark, tmp_path):
    """More layouts than any list on the driver should hold; building the read starts no job."""
    for i in range(2_000):
        (tmp_path / f"{i}.csv").write_text(f"Col{i},Account,Date,Debit,Credit,Description\nx,P9,2031-01-01,{i + 1}.00,,SHOP\n")
    group = "layouts"
    spark.sparkContext.setJobGroup(group, "")
    read = statements.read_statements(spark, str(tmp_path))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")
    assert read.count() == 2_000
    assert ingest.map_statements(read).agg(F.sum("amount_cents")).first()[0] == -100 * sum(range(1, 2_001))


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text(HEADER + 'S1,01/07/26,"TWO\nLINES",10.00,,,Debit\nS1,02/07/26,ONE,1.00,,,Debit\n')
    read = statements.read_statements(spark, str(tmp_path), multi_line=True)
    assert rows_of(ingest.map_statements(read), "amount_cents", "status") == [(-100, "ok"), (-1000, "ok")]


def test_quoted_line_breaks_over_splits(spark, tmp_path):
    """Files cut in the middle of quoted fields, against the csv module; no task reads more than a split."""
    import csv
    import random

    rng = random.Random(8)
    pieces = ["A", "B, C", 'say ""so""', "\n", "\r\n", "\n\n", "été", " ", "x" * 50]
    for name in ("a.csv", "b.csv"):
        rows = "".join('S1,01/07/26,"' + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) + f'",{i + 1}.00,,,Debit\n' for i in range(700))
        (tmp_path / name).write_text(HEADER + rows, newline="")
    (tmp_path / "c.csv").write_text(HEADER + 'S1,01/07/26,"' + "long\n" * 9_000 + '",1.00,,,Debit\nS1,01/07/26,LAST,2.00,,,Debit', newline="")
    want = []
    for name in ("a.csv", "b.csv", "c.csv"):
        with open(tmp_path / name, newline="") as file:
            want += [(name, row[2], row[3]) for row in list(csv.reader(file))[1:]]
    for limit in ("7000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            read = statements.read_statements(spark, str(tmp_path), multi_line=True)
            got = read.select(F.substring_index("file_path", "/", -1).alias("f"), F.col("descriptions")[0].alias("d"), "debit", "batch_ord").collect()
            assert limit != "7000" or statements._records(spark, str(tmp_path), False).rdd.getNumPartitions() > 10
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted((r.f, r.d, r.debit) for r in got) == sorted(want)
        for name in ("a.csv", "b.csv"):
            assert [r.debit for r in sorted((r for r in got if r.f == name), key=lambda r: r.batch_ord)] == [f"{i + 1}.00" for i in range(700)]


def test_row_order_over_splits(spark, tmp_path):
    lines = "".join(f"S1,01/07/26,SHOP {i:05d},{i + 1}.00,,,Debit\n" for i in range(4_000))
    (tmp_path / "x.csv").write_text(HEADER + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = statements.read_statements(spark, str(tmp_path))
        assert statements._records(spark, str(tmp_path), False).rdd.getNumPartitions() > 3
        got = read.orderBy("batch_ord").select("descriptions", "batch_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.descriptions[0] for r in got] == [f"SHOP {i:05d}" for i in range(4_000)]
    assert len({r.batch_ord for r in got}) == 4_000


FEED = [
    dict(account_id="u", entry_reference="R1", booking_date="2026-07-01", transaction_amount=dict(amount="12.50", currency="EUR"),
         credit_debit_indicator="DBIT", status="BOOK", creditor=dict(name="Shop Ltd"), remittance_information=["a ", "", "b"]),
    dict(account_id="u", value_date="2026-07-02", transaction_amount=dict(amount="-5"), credit_debit_indicator="crdt",
         debtor=dict(name="Boss"), creditor=dict(name="Me"), remittance_information="plain text"),
    dict(account_id="u", booking_date="2026-07-03", transaction_amount=dict(amount="1.00"), credit_debit_indicator="DBIT",
         status="PDNG"),
    dict(account_id="u", booking_date="2026-07-03", transaction_amount=dict(amount="1.00", currency="usd"),
         credit_debit_indicator="DBIT", status="booked"),
    dict(account_id="u", booking_date="2026-07-03", transaction_amount=dict(amount="1.00")),
    dict(account_id="u", booking_date="2026-13-45", transaction_amount=dict(amount="1.00"), credit_debit_indicator="DBIT"),
    dict(account_id="u", booking_date="2026-07-03", transaction_amount=dict(amount="1,2"), credit_debit_indicator="DBIT"),
    dict(account_id="u", transaction_amount=dict(amount="1.00"), credit_debit_indicator="DBIT"),
]


def write_feed(path, records):
    import json

    path.write_text("".join(json.dumps(r) + "\n" for r in records))


def test_feed_mapping(spark, tmp_path):
    from ledgerloom.sources.feed import read_feed

    write_feed(tmp_path / "f.json", FEED)
    got = ingest.map_feed(read_feed(spark, str(tmp_path))).orderBy("batch_ord").collect()
    assert [(r.status, r.reason) for r in got] == [
        ("ok", None), ("ok", None), ("skip", "not_booked"), ("reject", "foreign_currency"), ("reject", "no_direction"),
        ("reject", "bad_date"), ("reject", "bad_amount"), ("skip", "no_date")]
    first, second = got[0], got[1]
    assert (first.id, first.amount_cents, first.merchant_raw, first.description) == ("R1", -1_250, "Shop Ltd", "a b")
    assert (second.id, second.amount_cents, second.merchant_raw, second.description, second.currency) == (
        None, 500, "Boss", "plain text", "EUR")
    assert second.booking_date == date(2026, 7, 2)


def test_row_contract(spark):
    rows = [("5", "2026-01-01", "csv", "a", None), ("12.5", "2026-01-01", "csv", "a", "EUR"), ("5", "01/02/2026", "api", "a", "EUR"),
            ("5", "2026-01-01", "manual", "a", "EUR"), ("5", "2026-01-01", "api", "", "EUR"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "amount_cents string, booking_date string, source string, account_id string, currency string")
    got = ingest.validate(df)
    assert sorted(r.reason or "ok" for r in got.collect()) == ["bad_amount", "bad_amount", "bad_date", "bad_source", "no_account", "ok"]
    assert rows_of(ingest.accepted(got)) == [(5, date(2026, 1, 1), "csv", "a", "EUR")]


BATCH = "id string, account_id string, booking_date date, amount_cents long, merchant_raw string, batch_id string, batch_ord long"


def batch_of(spark, rows, batch="f"):
    return spark.createDataFrame(
        [(i, "a", date(2026, 1, 3), c, m, batch, n) for n, (i, c, m) in enumerate(rows)], BATCH)


def test_ids(spark):
    got = ingest.assign_ids(batch_of(spark, [(None, -350, "CAFE"), ("R9", -350, "CAFE"), (None, -350, "CAFE"), ("", -1, None)]))
    base = "2026-01-03|-350|CAFE|a"
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert [r.id for r in got.orderBy("batch_ord").collect()] == [
        sha(base), "R9", sha(base + "|1"), sha("2026-01-03|-1||a")]


@pytest.mark.parametrize("block_rows", [1, 3, 1_000_000])
def test_ids_of_a_hot_booking_in_small_blocks(spark, block_rows):
    rows = [(None, -350, "CAFE") if i % 3 else (None, -i, "OTHER") for i in range(100)]
    got = ingest.assign_ids(batch_of(spark, rows), block_rows=block_rows, hot_rows=10)
    assert rows_of(got, "id") == rows_of(ingest.assign_ids(batch_of(spark, rows)), "id")
    assert got.select("id").distinct().count() == 100


def test_ids_do_not_depend_on_order(spark):
    rows = [(None, -350, "CAFE")] * 3 + [(None, -1, "X"), (None, -2, "X")]
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    assert rows_of(ingest.assign_ids(batch_of(spark, rows)), "id") == rows_of(ingest.assign_ids(batch_of(spark, shuffled)), "id")


def test_second_append_adds_nothing_and_first_wins(spark):
    batch = ingest.assign_ids(batch_of(spark, [(None, -350, "CAFE"), (None, -350, "CAFE"), ("R1", -5, "FIRST"), ("R1", -6, "SECOND")]))
    empty = spark.createDataFrame([], BATCH)
    stored = ingest.append_new(empty, batch)
    assert stored.count() == 3
    assert rows_of(stored.filter("id = 'R1'"), "merchant_raw") == [("FIRST",)]
    assert ingest.append_new(stored, batch).count() == 0
    later = ingest.assign_ids(batch_of(spark, [(None, -350, "CAFE")], "g"))
    assert ingest.append_new(stored, later).count() == 0
    monthly = stored.withColumn("booking_month", F.lit("2026-01"))
    assert ingest.append_new(monthly, batch, ["2026-01"]).count() == 0
    assert ingest.append_new(monthly, batch, ["2025-12"]).count() == 3


def test_quarantine_keeps_each_row_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "S1,soon,A,5.00,,,Debit\nS1,soon,A,5.00,,,Debit\nS1,later,B,5.00,,,Debit\n")
    bad = ingest.rejected(load(spark, tmp_path))
    payload = ["account", "date", "descriptions", "debit", "credit"]
    first = ingest.quarantine(bad, None, payload)
    assert first.count() == 2
    assert ingest.quarantine(bad, first, payload).count() == 0
    assert rows_of(ingest.quarantine_summary(first)) == [("csv", "bad_date", 2)]
    row = first.filter(F.col("raw").contains("later")).first()
    assert row.fingerprint == hashlib.sha256(f"csv|{row.raw}".encode()).hexdigest()


LEDGER = "account_id string, booking_date date, source string"


def test_clip_boundary(spark):
    api = spark.createDataFrame([("a", date(2026, 4, 20), "api"), ("a", date(2025, 11, 2), "api"), ("b", date(2026, 7, 13), "api")], LEDGER)
    cursor = spark.createDataFrame([("a", date(2026, 7, 1), date(2026, 4, 15)), ("b", date(2026, 7, 1), date(2026, 4, 15))],
                                   schema.SOURCE_CURSOR)
    assert rows_of(ingest.clip_boundary(api, cursor)) == [("a", date(2026, 4, 15)), ("b", date(2026, 7, 13))]
    assert rows_of(ingest.clip_boundary(api, cursor, [])) == [(date(2026, 4, 15),)]
    assert rows_of(ingest.clip_boundary(api, None, [])) == [(date(2025, 11, 2),)]
    stmt = spark.createDataFrame([("b", date(2026, 7, 12), "csv"), ("b", date(2026, 7, 13), "csv"), ("c", date(2026, 7, 13), "csv")], LEDGER)
    flagged = ingest.clip_overlap(stmt, ingest.clip_boundary(api, cursor))
    assert rows_of(flagged, "account_id", "booking_date", "clipped") == [
        ("b", date(2026, 7, 12), False), ("b", date(2026, 7, 13), True), ("c", date(2026, 7, 13), False)]
    none = ingest.clip_overlap(stmt, ingest.clip_boundary(api.limit(0), None, []), [])
    assert none.filter("clipped").count() == 0


def test_cursor_moves_forward_only(spark):
    d = date
    cursor = spark.createDataFrame([("back", d(2026, 7, 10), d(2026, 4, 1)), ("cut", d(2026, 7, 10), d(2026, 4, 1)),
                                    ("idle", d(2026, 7, 10), None), ("on", d(2026, 7, 10), d(2026, 4, 1))], schema.SOURCE_CURSOR)
    batch = spark.createDataFrame([("back", d(2026, 7, 1), "api"), ("cut", d(2026, 7, 20), "api"), ("on", d(2026, 7, 20), "api"),
                                   ("new", d(2026, 7, 5), "api")], LEDGER)
    pulls = spark.createDataFrame([("back", d(2026, 7, 5), False), ("cut", d(2026, 7, 5), True), ("on", d(2026, 7, 5), False),
                                   ("new", d(2026, 4, 15), False), ("held", d(2026, 4, 15), True)], "account_id string, since date, truncated boolean")
    moved = ingest.advance_cursor(cursor, batch, pulls)
    assert rows_of(moved) == [
        ("back", d(2026, 7, 10), d(2026, 4, 1)), ("cut", d(2026, 7, 10), d(2026, 4, 1)), ("held", None, d(2026, 4, 15)),
        ("idle", d(2026, 7, 10), None), ("new", d(2026, 7, 5), d(2026, 4, 15)), ("on", d(2026, 7, 20), d(2026, 4, 1))]
    since = dict(rows_of(ingest.pull_from(moved, d(2026, 4, 15), 5), "account_id", "since"))
    assert since["on"] == d(2026, 7, 15) and since["held"] == d(2026, 4, 15)


def test_audit_counts_what_the_clip_takes(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "".join(
        f"P9,{day}/03/2031,QUAY,{amount},,,Card\n" for day, amount in (("02", "1.00"), ("x", "1.00"), ("02", "0.00"), ("19", "2.00"), ("20", "3.00"))))
    clip = spark.createDataFrame([(date(2031, 3, 19),)], "clip_before date")
    staged = load(spark, tmp_path, clip=clip)
    good = ingest.assign_ids(ingest.accepted(staged).drop("clipped"))
    audit = ingest.ingest_audit(staged, ingest.append_new(good.limit(0), good)).first()
    assert (audit.submitted, audit.new, audit.duplicate, audit.skipped, audit.quarantined, audit.clipped) == (1, 1, 0, 1, 1, 2)
    again = ingest.ingest_audit(staged, ingest.append_new(good, good)).first()
    assert (again.new, again.duplicate) == (0, 1)


def test_broken_lines_and_missing_accounts_are_quarantined(spark, tmp_path):
    from ledgerloom.sources.feed import read_feed

    whole = dict(account_id="u", booking_date="2031-07-01", transaction_amount=dict(amount="2.00"), credit_debit_indicator="DBIT")
    write_feed(tmp_path / "f.json", [whole, whole | {"account_id": None}, whole | {"account_id": " "}])
    with (tmp_path / "f.json").open("a") as file:
        file.write('{"account_id": "u", "booking_date": "2031-07')
    mapped = ingest.checked(ingest.map_feed(read_feed(spark, str(tmp_path))))
    assert [(r.status, r.reason) for r in mapped.orderBy("batch_ord").collect()] == [
        ("ok", None), ("reject", "no_account"), ("reject", "no_account"), ("reject", "unreadable")]
    stored = ingest.quarantine(ingest.rejected(mapped), None)
    assert stored.filter("reason = 'unreadable'").first().raw == '{"account_id": "u", "booking_date": "2031-07'
    assert ingest.quarantine(ingest.rejected(mapped), stored).count() == 0


def test_feed_and_statement_rows_meet_on_the_same_id(spark, tmp_path):
    from ledgerloom.sources.feed import read_feed

    write_feed(tmp_path / "f.json", [dict(account_id="S1", booking_date="2026-07-01", transaction_amount=dict(amount="5.00"),
                                          credit_debit_indicator="DBIT", creditor=dict(name="SHOP"))])
    (tmp_path / "a.csv").write_text(HEADER + "S1,01/07/26,SHOP,5.00,,,Debit\n")
    feed = ingest.assign_ids(ingest.accepted(ingest.map_feed(read_feed(spark, str(tmp_path / "f.json")))))
    stmt = ingest.assign_ids(ingest.accepted(load(spark, tmp_path / "a.csv")))
    assert rows_of(feed, "id") == rows_of(stmt, "id")
    both = ingest.combine(feed, stmt)
    assert both.count() == 2 and ingest.append_new(both.limit(0), both).count() == 1


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("2026-01", 1), ("2026-02", 2)], "booking_month string, v int")
    tables.write_table(df, path, partition_by=["booking_month"])
    tables.write_table(df.filter("v = 2").withColumn("v", F.lit(9)), path, partition_by=["booking_month"])
    assert rows_of(tables.read_table(spark, path, df.schema), "booking_month", "v") == [("2026-01", 1), ("2026-02", 9)]
    assert tables.read_table(spark, str(tmp_path / "none"), df.schema).count() == 0


def test_shared_folder_prefers_the_cluster_setting(tmp_path):
    from types import SimpleNamespace

    def session(**settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: settings.get(name.split(".")[1], default)))

    assert tables.shared_folder(session(master="local[4]"), tmp_path / "own") == str(tmp_path / "own")
    assert tables.shared_folder(session(master="yarn", checkpoint="/shared/x"), tmp_path / "own") == "/shared/x"
    with pytest.raises(ValueError):
        tables.shared_folder(session(master="spark://host:1"), tmp_path / "own")
