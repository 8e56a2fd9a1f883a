from datetime import date, datetime

from conftest import rows_of
from pyspark.sql import functions as F

from ledgerloom.config import Rule
from ledgerloom.operators import categorize as cat
from ledgerloom.operators import labels, merchants, scan

REQUEST = "request_id string, actor_id string, ref string, category string, ts timestamp"
RULES = [Rule("UBER ?EATS", "FoodDelivery"), Rule(r"\bUBER\b", "Transport"), Rule("MARKET", "Groceries")]


def ledger_with_ids(spark, *rows):
    df = spark.createDataFrame(rows, "id string, merchant_raw string")
    return merchants.with_merchant_key(df).withColumn("booking_date", F.lit(date(2026, 7, 1)))


def requests(spark, *rows):
    data = [(str(i), "owner", ref, c, datetime(2026, 7, 1, 9, i)) for i, (ref, c) in enumerate(rows)]
    return spark.createDataFrame(data, REQUEST)


def test_reference_outcomes(spark):
    ledger = ledger_with_ids(spark, ("abcdef11", "POS SHOP"), ("abcdef22", "SHOP"), ("zzzzzz99", None), ("ABCDEF33", "X"), ("abc%ef77", "Y"))
    asked = requests(spark, ("abcdef", "Gifts"), (" abcdef1 ", "gifts"), ("abcde", "Gifts"), ("nothere", "Gifts"),
                     ("zzzzzz", "Cash"), ("abcdef1", "Nope"), ("abc%ef", "Gifts"), ("abcdef11", "Gifts"), ("abcdef112", "Gifts"))
    got = labels.resolve_labels(asked, ledger).orderBy("request_id").collect()
    assert [r.status for r in got] == ["ambiguous", "ok", "too_short", "not_found", "ok", "unknown_category", "ok", "ok", "not_found"]
    assert (got[1].txn_id, got[1].merchant_key, got[1].category) == ("abcdef11", "SHOP", "Gifts")
    assert got[4].merchant_key is None
    events = labels.label_events(labels.resolve_labels(asked, ledger))
    assert rows_of(events.filter("txn_id = 'zzzzzz99' or category = 'Cash'"), "scope", "txn_id") == [("txn", "zzzzzz99")]
    assert labels.resolve_labels(asked.filter("ref = 'abcde'"), ledger).first().status == "too_short"


def test_correction_teaches_the_merchant_and_latest_wins(spark):
    ledger = ledger_with_ids(spark, ("aaaaaa1", "SHOP 12"), ("bbbbbb2", "SHOP"), ("cccccc3", "UBER EATS"), ("dddddd4", "UBER TRIP"),
                             ("eeeeee5", None), ("ffffff6", "WHO KNOWS"))
    events = labels.label_events(labels.resolve_labels(requests(spark, ("aaaaaa1", "Gifts"), ("bbbbbb2", "Cash")), ledger))
    events = events.unionByName(labels.override_one(requests(spark, ("dddddd4", "")).withColumn("request_id", F.lit("d")), ledger))
    dims = cat.categorize(merchants.build_merchants(ledger), labels.latest_labels(events.unionByName(events)), RULES)
    full = cat.categorized(ledger, dims, labels.latest_overrides(events))
    assert rows_of(full, "id", "category") == [
        ("aaaaaa1", "Gifts"), ("bbbbbb2", "Cash"), ("cccccc3", "FoodDelivery"), ("dddddd4", "Dates"),
        ("eeeeee5", "Uncategorized"), ("ffffff6", "Uncategorized")]
    assert rows_of(cat.cascade_stats(dims)) == [("manual", 1), ("regex", 2), ("unresolved", 1)]
    shop = dims.filter("merchant_key = 'SHOP'").first()
    assert (shop.category, shop.categorized_by) == ("Cash", "manual")


def test_label_validity(spark):
    keys = ["MARKET A", "MARKET B", "MARKET C", "MARKET D", "MARKET E"]
    dims = spark.createDataFrame([(k, date(2026, 1, 1)) for k in keys], "merchant_key string, first_seen date")
    known = spark.createDataFrame(
        [("MARKET A", "Nonsense", "manual", 1.0), ("MARKET B", "Uncategorized", "dict", 1.0), ("MARKET C", "Uncategorized", "manual", 1.0),
         ("MARKET D", "Gifts", "guess", 0.4), ("market e", "Gifts", "manual", 1.0)],
        "merchant_key string, category string, by string, confidence double")
    got = cat.categorize(dims, known, RULES)
    assert rows_of(got, "merchant_key", "category", "categorized_by") == [
        ("MARKET A", "Groceries", "regex"), ("MARKET B", "Groceries", "regex"), ("MARKET C", "Uncategorized", "manual"),
        ("MARKET D", "Gifts", "dict"), ("MARKET E", "Groceries", "regex")]
    assert rows_of(merchants.stale_label_keys(known), "merchant_key") == [("market e",)]


def test_many_rules_stay_in_order(spark):
    many = [Rule(f"^NAME{i}$", "Cash") for i in range(600)] + [Rule("NAME5", "Gifts"), Rule("NAME", "Fees")]
    df = spark.createDataFrame([("NAME599",), ("NAME5X",), ("NAMEX",), ("Z",)], "k string")
    assert rows_of(df.select("k", cat.match_rules(F.col("k"), many))) == [
        ("NAME599", "Cash"), ("NAME5X", "Gifts"), ("NAMEX", "Fees"), ("Z", None)]
    assert df.select(cat.match_rules(F.col("k"), [])).first()[0] is None


def test_merchants_and_collisions(spark):
    df = spark.createDataFrame(
        [("Shop 12", date(2026, 3, 1)), ("SHOP 44", date(2026, 1, 1)), ("FILMS { A }", date(2026, 2, 1)), ("FILMS { B }", date(2026, 2, 2)),
         (None, date(2026, 1, 1)), ("  ", date(2026, 1, 1))], "merchant_raw string, booking_date date")
    assert rows_of(merchants.build_merchants(df)) == [("FILMS", date(2026, 2, 1)), ("SHOP", date(2026, 1, 1))]
    assert rows_of(merchants.key_collisions(df)) == [("SHOP", 2, "SHOP 12", "SHOP 44")]


def test_only_authorized_actors(spark):
    events = spark.createDataFrame([("1", "owner"), ("2", "guest")], "event_id string, actor_id string")
    actors = spark.createDataFrame([("owner",), ("owner",)], "actor_id string")
    assert rows_of(labels.authorized(events, actors)) == [("1", "owner")]


def test_scans(spark):
    key = "sk-" + "A1b2" * 6
    df = spark.createDataFrame([(1, f"a {key} b {key}"), (2, "-----BEGIN RSA PRIVATE KEY-----"), (3, "AKIA" + "A" * 16), (4, None), (5, "plain")],
                               "n int, text string")
    assert rows_of(scan.scan_shapes(df, "text")) == [("api_key", 1, 2), ("chat_token", 0, 0), ("cloud_key", 1, 1), ("private_key", 1, 1)]
    assert rows_of(scan.flag_shapes(df, "text").filter("has_api_key"), "n") == [(1,)]
    assert rows_of(scan.scan_patterns(df, "text", ["# x", "", "PLAIN", "akia"]), "n") == [(3,), (5,)]
    assert scan.scan_patterns(df, "text", ["# only a comment"]).count() == 0
    assert rows_of(scan.redact(df, "text", [key, ""]).filter("n = 1"), "text") == [("a *** b ***",)]
