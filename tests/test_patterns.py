"""Rules, caps and bills as tables: the same answers as the lists, by index and without nested loops."""

import random
import re
from datetime import date

import pytest
from conftest import rows_of
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.config import Bill, Policy, Rule
from ledgerloom.operators import bills, categorize, patterns, policy
from ledgerloom.sources import star

FOLDER = "/root/testdata/sf0.001"
SHAPES = (r"\b{a}\b", "{a}", "^{a}", "{a}$", r"\b({a}|{b})\b", "{a}|{b}", "({a}|{b})? ?{c}", "[{a}]+ {b}", "{a}.*{b}", "{a}+", "({a})+{b}*",
          r"{a}\s*{b}?", "(?i){a}", "{a}{{2,}}", "{a}{{0,1}}{b}", r"\Q{a}\E", "(({a}|{b}) {c})", "[^{a}]{b}", r"{a}\.{b}", r"\x41{a}", "{a}?", "", r"\$?{a}$")
WORDS = ("CAFE", "CAF", "ROSE", "BAKERY", "E", "AB", "TEA ROOM", "GREEN", "GREENGROCER", "SHOP")


def made_patterns(n, seed=1):
    rng = random.Random(seed)
    return [rng.choice(SHAPES).format(a=rng.choice(WORDS), b=rng.choice(WORDS), c=rng.choice(WORDS)) for _ in range(n)]


def made_names(n, seed=2):
    rng = random.Random(seed)
    glue = ["", " ", " ", "S ", ".", "$"]
    return sorted({"".join(rng.choice(WORDS) + rng.choice(glue) for _ in range(rng.randint(0, 4))) for _ in range(n)})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_match_holds_a_required_text(spark):
    """Against every name, by the engine that runs the patterns."""
    rows = spark.createDataFrame([(p,) for p in sorted(set(made_patterns(400)))], "pattern string").withColumn(
        "texts", patterns.required_texts(F.col("pattern")))
    names = spark.createDataFrame([(n,) for n in made_names(300)], "name string")
    hits = names.crossJoin(rows).filter(F.rlike(F.col("name"), F.col("pattern")))
    assert hits.count() > 5000
    held = F.exists("texts", lambda t: F.col("name").contains(t))
    assert hits.filter((F.size("texts") > 0) & ~held).isEmpty()
    assert rows.filter(F.size("texts") > 0).count() > 0.5 * rows.count()
    assert all(len(t) >= patterns.GRAM for r in rows.collect() for t in r.texts)


def test_five_thousand_rules_equal_the_list(spark):
    rng = random.Random(7)
    rules = [Rule(p, rng.choice(["Gifts", "Travel", "Cash", "Tools"])) for p in made_patterns(300)]
    rules += [Rule(rf"\b{''.join(rng.choices('ABCDEFGHIJ', k=5))}\b", "Dates") for _ in range(4700)]
    rng.shuffle(rules)
    names = made_names(150) + ["".join(rng.choices("ABCDEFGHIJ ", k=40)) for _ in range(100)]
    merchants = spark.createDataFrame([(n,) for n in names] + [(None,)], "merchant_key string").distinct()
    table = patterns.rules_table(spark, rules)
    found = categorize.categorize(merchants, None, table)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert unwanted not in plan_of(found)
    first = {n: next((r.category for r in rules if re.search(r.pattern.replace(r"\Q", "").replace(r"\E", ""), n)), "Uncategorized") for n in names}
    assert dict(rows_of(found.filter("merchant_key IS NOT NULL"), "merchant_key", "category")) == first
    listed = categorize.categorize(merchants, None, rules[:200])
    tabled = categorize.categorize(merchants, None, table.filter("ord < 200"))
    assert rows_of(listed, *listed.columns) == rows_of(tabled, *listed.columns)


def test_patterns_without_text_are_bounded(spark):
    names = spark.createDataFrame([("CAFE",), ("TEA",)], "merchant_key string")
    table = spark.createDataFrame([(i, f"E.{{0,{i}}}$") for i in range(5)], "number long, pattern string")
    assert len(rows_of(patterns.matches(names, table, residual=5))) == 9
    with pytest.raises((PySparkException, Py4JError), match="5 patterns name no text"):
        patterns.matches(names, table, residual=4).collect()
    none = patterns.matches(names, table.filter("number < 0"))
    assert none.isEmpty() and patterns.matches(names.limit(0), table).isEmpty()


def test_rules_of_one_account_leave_others_alone(spark):
    names = spark.createDataFrame([("a", "TEA ROOM"), ("b", "TEA ROOM"), ("b", "SHOP"), (None, "SHOP")], "account_id string, merchant_key string")
    rules = spark.createDataFrame([("a", 1, "ROOM", "Gifts"), ("a", 0, "M$", "Cash"), ("b", 5, "TEA", "Travel"), ("b", 6, None, "Fees"), ("b", 7, "P$", "Tools")],
                                  "account_id string, ord long, pattern string, category string")
    assert rows_of(patterns.first_rules(names, rules, ["account_id"])) == [
        ("a", "TEA ROOM", "Cash"), ("b", "SHOP", "Tools"), ("b", "TEA ROOM", "Travel")]


def broadcasts(df):
    """Joins of the plan that send a whole table to every task by way of the driver, but for those of the bounded slot tables."""
    return [line for line in plan_of(df).splitlines() if re.search("BroadcastHashJoin|NestedLoop", line) and "_slot" not in line]


def test_rules_move_a_name_once_however_many_letters_it_has(spark):
    """Names with a row for each letter went to tasks and, as their size was taken for small, to the driver."""
    names = spark.createDataFrame([("TEA ROOM " * 20 + "CAFE",), ("SHOP",)], "merchant_key string")
    rules = patterns.rules_table(spark, [Rule("CAFE$", "Gifts"), Rule("ROOM", "Cash"), Rule("P$", "Tools")])
    found = categorize.categorize(names, None, rules)
    assert broadcasts(found) == []
    counted = patterns.matches(names, rules.select(F.col("ord").alias("number"), "pattern")).groupBy("number").count()
    assert broadcasts(counted) == []
    for df in (found, counted):
        plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = re.findall(r"Exchange\nInput \[\d+\]: (\[.*\])\nArguments: hashpartitioning\(.*gram", plan)
        assert moved and not any("merchant_key" in columns for columns in moved)
    assert sorted(r.category for r in found.collect()) == ["Gifts", "Tools"] and rows_of(counted) == [(0, 1), (1, 1), (2, 1)]


def test_names_that_repeat_and_patterns_that_repeat(spark):
    names = spark.createDataFrame([("a", "TEA ROOM")] * 2 + [("a", None), (None, "TEA")], "account_id string, merchant_key string")
    table = spark.createDataFrame([("a", 1, "ROOM"), ("a", 1, "ROOM"), ("a", 1, "TEA|ROOM"), ("a", 2, "M$"), ("a", 2, "M$"), ("a", 3, "GYM"),
                                   (None, 4, "TEA")], "account_id string, number long, pattern string")
    assert rows_of(patterns.matches(names, table, ["account_id"])) == [("a", "TEA ROOM", 1), ("a", "TEA ROOM", 2), ("a", "TEA ROOM", 2)]
    rules = table.select(F.col("number").alias("ord"), "pattern", F.lit("Gifts").alias("category"))
    assert len(rows_of(categorize.categorize(names, None, rules))) == 4


POLICIES = [Policy("house", 900, pattern="VIEW HOUSE|^PURCHASE"), Policy("food", 1_500, bucket="FoodDelivery"),
            Policy("end", 700, pattern="E$"), Policy("sweet", 400, sub_label="Coffee/Snacks")]


def test_own_caps_equal_the_list_where_all_are_alike(spark):
    events = star.event_ledger(spark, FOLDER)
    table = patterns.policies_table(spark, POLICIES, events.select("account_id").distinct())
    for make in (policy.match_policies, policy.policy_progress, policy.policy_alerts):
        listed, tabled = make(events, POLICIES), make(events, table)
        columns = [c for c in listed.columns if c != "booking_ts"]
        assert rows_of(tabled, *columns) == rows_of(listed, *columns)
    assert "NestedLoop" not in plan_of(policy.policy_alerts(events, table))


def test_own_caps_differ_and_the_first_one_decides(spark, ledger_of):
    one = ledger_of([("2026-03-01", "TEA ROOM", -500, "Groceries"), ("2026-03-02", "TEA ROOM", -600, "Groceries"), ("2026-03-03", "TEA", -900, "Rent")], "a")
    two = ledger_of([("2026-03-01", "TEA ROOM", -500, "Groceries"), ("2026-03-05", None, -5_000, "Groceries")], "b").withColumn("id", F.concat(F.lit("b"), "id"))
    both = one.unionByName(two)
    table = spark.createDataFrame(
        [("a", 3, "cap", 1_000, "Groceries", None, None), ("a", 1, "wide", 9_000, None, None, "ROOM$"), ("b", 0, "tea", 400, None, None, "TEA"),
         ("b", 2, "label", 100, None, "Groceries", None), ("c", 0, "none", 0, None, "Rent", None)],
        "account_id string, ord long, policy string, cap_cents long, bucket string, sub_label string, pattern string")
    alerts = rows_of(policy.policy_alerts(both, table), "account_id", "policy", "mtd_cents", "charge_number")
    assert alerts == [("b", "label", 5_500, 2), ("b", "tea", 500, 1)]
    progress = policy.policy_progress(both, table)
    assert rows_of(progress.filter("account_id = 'a'"), "policy", "mtd_cents", "is_first") == [
        ("cap", 1_100, False), ("cap", 500, False), ("wide", 1_100, True), ("wide", 500, True)]


def test_own_caps_are_not_broadcast(spark):
    """Rows listed in a row of the accounts are more than the planner takes them for."""
    events = star.event_ledger(spark, FOLDER)
    table = patterns.policies_table(spark, POLICIES, events.select("account_id").distinct())
    for df in (policy.match_policies(events, table), policy.policy_alerts(events, table)):
        assert broadcasts(df) == []


BILLS = [Bill("one", "^PURCHASE", 20, 900, 20), Bill("two", r"\bHOUSE$", 31, 500, 50), Bill("three", "K HOUSE", 3, 700, 0)]


def test_own_bills_equal_the_list_where_all_are_alike(spark):
    events = star.event_ledger(spark, FOLDER)
    table = patterns.bills_table(spark, BILLS, events.select("account_id").distinct())
    for day in (date(2024, 1, 2), date(2024, 1, 25), date(2024, 2, 29)):
        listed = bills.bill_state(events, BILLS, day)
        assert rows_of(bills.own_bill_state(events, table, day), *listed.columns) == rows_of(listed, *listed.columns)
        tabled = bills.bill_checklist(bills.own_bill_state(events, table, day))
        assert rows_of(tabled) == rows_of(bills.bill_checklist(listed))
    assert "NestedLoop" not in plan_of(bills.own_bill_state(events, table, date(2024, 1, 25)))


def test_own_bills_on_several_days(spark, ledger_of):
    rows = ledger_of([("2026-01-27", "ROSE RENT", -900, "Rent"), ("2026-02-26", "ROSE RENT", -1_200, "Rent"), ("2026-03-02", "ROSE RENT", -900, "Rent"),
                      ("2026-03-01", "ROSE RENT", 900, "Rent")], "a")
    days = ["2026-01-26", "2026-01-31", "2026-02-27", "2026-03-01", "2026-03-31"]
    table = spark.createDataFrame([("a", "rent", "RENT$", 31, 900, 10, date.fromisoformat(d)) for d in days]
                                  + [("b", "gym", "GYM", 5, 100, 0, date(2026, 3, 31))],
                                  "account_id string, bill string, pattern string, due_day int, expected_cents long, tolerance_pct int, as_of date")
    got = rows_of(bills.own_bill_state(rows, table), "account_id", F.col("as_of").cast("string"), F.col("due").cast("string"), F.col("paid_on").cast("string"), "paid_cents", "overdue")
    assert got == sorted([
        ("a", "2026-01-26", "2025-12-31", None, None, True), ("a", "2026-01-31", "2026-01-31", "2026-01-27", 900, False),
        ("a", "2026-02-27", "2026-01-31", "2026-02-26", 1_200, False), ("a", "2026-03-01", "2026-02-28", "2026-02-26", 1_200, False),
        ("a", "2026-03-31", "2026-03-31", None, None, False), ("b", "2026-03-31", "2026-03-05", None, None, True)], key=repr)


def test_own_bills_are_not_broadcast(spark):
    events = star.event_ledger(spark, FOLDER)
    state = bills.own_bill_state(events, patterns.bills_table(spark, BILLS, events.select("account_id").distinct()), date(2024, 1, 25))
    assert broadcasts(state) == [] and broadcasts(bills.bill_alerts(state)) == []
