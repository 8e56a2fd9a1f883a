"""The registered queries: every operator run over whole tables."""

from __future__ import annotations

import tempfile
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import Bill, Policy, Rule
from ledgerloom.functions.dates import day_in_month, iso_week_key, month_start, parse_date
from ledgerloom.functions.money import format_eur, ordinal, parse_cents, plain_amount
from ledgerloom.functions.names import display_name, identity_name, merchant_key
from ledgerloom.operators import bills as bill_ops
from ledgerloom.operators import categorize as cat
from ledgerloom.operators import cycle, ingest, labels, merchants, patterns, policy, progress, recon, recurring, rhythm, scan, spend
from ledgerloom.plans import refresh
from ledgerloom.sources import star
from ledgerloom.sources.tables import keep, keep_bucketed
from ledgerloom.streaming import windows

AS_OF = date(2001, 6, 30)
WINDOW = (date(2001, 4, 1), AS_OF)
LONG_WINDOW = (date(1999, 1, 15), AS_OF)
EVENTS_AS_OF = date(2024, 1, 25)
POOL_CENTS = 9_000_000
THRESHOLD = 3_000_000

POLICIES = [
    Policy("view-cap", 1_500, bucket="FoodDelivery"),
    Policy("shop-cap", 4_000, pattern="^(VIEW|PURCHASE) HOUSE$"),
    Policy("misc-cap", 3_000, bucket="Other"),
]
BILLS = [
    Bill("Groceries box", "^PURCHASE", 20, 900, 20),
    Bill("Viewing", r"\bHOUSE$", 24, 500, 50),
    Bill("Old club", "^CLUB", 15, 1_000, 10),
    Bill("Month end", "^CLICK", 31, 1_200, 25),
]
EVENT_LIMITS = recurring.RecurringLimits(
    min_occurrences=3, amount_cv_max=1.2, monthly_days=(28, 32), weekly_days=(2, 8), mad_max_days=3)
PATTERN_LINES = ["# names and places", "", r"\bwhst\b", "eaux+ le", r"[0-9]{3}-[0-9]{4}"]
REDACT = ["the", "ou", ""]

EPOCH = date(1995, 1, 1)


def _household(spark: SparkSession, sf: str) -> DataFrame:
    return star.household_ledger(spark, sf)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


# ── ingest ────────────────────────────────────────────────────────────────────

def money_parse(spark, sf):
    rows = star.statement_rows(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat("debit", "credit").alias("text"))
    cents = F.col("cents")
    return rows.withColumn("cents", parse_cents(F.col("text"))).withColumns({
        "eur": format_eur(cents), "plain": plain_amount(cents), "place": ordinal(F.col("l_orderkey"))})


def date_parse(spark, sf):
    return star.statement_rows(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "date", parse_date(F.col("date")).alias("parsed"))


def statement_map(spark, sf):
    mapped = ingest.map_statements(star.statement_rows(spark, sf), {"ACC-1-URGENT": "main", "ACC-5-LOW": "spare"})
    return mapped.select("l_orderkey", "l_linenumber", "l_partkey", "account_id", "booking_date", "amount_cents",
                         "currency", "merchant_raw", "status", "reason")


def feed_map(spark, sf):
    return ingest.map_feed(star.feed_rows(spark, sf)).select(
        "batch_ord", "id", "account_id", "booking_date", "value_date", "amount_cents", "currency",
        "merchant_raw", "description", "status", "reason")


def booked_rows(spark, sf):
    rows = ingest.booked(star.feed_rows(spark, sf))
    return rows.select("batch_ord", F.coalesce("status", F.lit("none")).alias("status"))


def row_contract(spark, sf):
    rows = star.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_quantity") == 3, "12.5").otherwise(star.cents(F.col("l_extendedprice")).cast("string"))
        .alias("amount_cents"),
        F.when(F.col("l_quantity") == 7, F.date_format("l_shipdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("booking_date"),
        F.when(F.col("l_returnflag") == "R", "manual").when(F.col("l_returnflag") == "A", "csv").otherwise("api")
        .alias("source"),
        F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_suppkey").cast("string")).alias("account_id"),
        F.when(F.col("l_linestatus") == "F", "EUR").alias("currency"))
    return ingest.validate(rows)


def currency_gate(spark, sf):
    feed = star.feed_rows(spark, sf).select(F.col("transaction_amount.currency").alias("currency"), "batch_ord")
    return ingest.currency_gate(feed).select("batch_ord", "status", "reason")


def account_labels(spark, sf):
    orders = star.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("account_label"))
    mapping = star.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("label")).distinct().filter(F.col("label") < "4").withColumn(
            "account_id", F.concat(F.lit("acc-"), F.substring("label", 1, 1)))
    return ingest.map_accounts(orders, mapping)


def _repeats(spark, sf):
    lines, parts = star.table(spark, sf, "lineitem"), star.table(spark, sf, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7),
               F.concat(F.lit("bank-"), "l_orderkey")).alias("id"),
        month_start(F.col("l_shipdate")).alias("booking_date"),
        (-F.col("l_quantity") * 100).cast("long").alias("amount_cents"),
        F.when(F.col("p_brand") != "Brand#13", F.substring_index("p_name", " ", -1)).alias("merchant_raw"),
        F.col("l_linestatus").alias("account_id"), F.col("l_returnflag").alias("batch_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("batch_ord"))


def row_ids(spark, sf):
    return ingest.assign_ids(_repeats(spark, sf)).select(
        "id", "booking_date", "amount_cents", "merchant_raw", "account_id", "batch_id")


def row_ids_hot(spark, sf):
    """The numbering of `row_ids` with every group cut into blocks, and rows without a batch."""
    repeats = _repeats(spark, sf).withColumn("batch_id", F.nullif(F.col("batch_id"), F.lit("N")))
    return ingest.assign_ids(repeats, block_rows=5_000, hot_rows=1).select(
        "id", "booking_date", "amount_cents", "merchant_raw", "account_id", "batch_id")


def feed_rejects(spark, sf):
    """Feed records without an account, and lines that are no record, as they go to quarantine."""
    kind, rows = F.col("debtor.name"), star.feed_rows(spark, sf)
    broken = F.when(F.col("batch_ord") % 7 == 0, F.concat(F.lit('{"account_id": "'), F.col("batch_ord").cast("string")))
    feed = rows.withColumns({
        "_corrupt_record": broken, "account_id": F.when(kind.startswith("purchase"), F.lit(" ")).otherwise(F.col("account_id"))})
    mapped = ingest.checked(ingest.map_feed(feed))
    return ingest.rejected(mapped).select("batch_ord", "reason", F.when(F.col("reason") == "unreadable", F.col("raw")).alias("raw"))


def long_names(spark, sf):
    """Whole document texts taken as merchant names, with codes and places at the end."""
    raw = F.concat(F.lit("POS "), F.replace(F.coalesce("text", F.lit("")), F.lit("ß"), F.lit("ss")), F.lit(" 123 CORK D2"))
    key = merchant_key(raw)
    return star.table(spark, sf, "documents").select("doc_id", F.length(key).alias("key_chars"), F.md5(key).alias("key_md5"))


def _keyed_lines(spark, sf):
    return star.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.to_date("l_shipdate").alias("booking_date"), "l_linestatus",
        star.cents(F.col("l_extendedprice")).alias("amount_cents"),
        F.concat_ws("/", F.date_format("l_shipdate", "yyyy-MM-dd"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
        .alias("batch_id"),
        star.cents(F.col("l_extendedprice")).alias("batch_ord"))


def append_once(spark, sf):
    lines = _keyed_lines(spark, sf)
    stored = lines.filter(F.col("l_linestatus") == "F")
    return ingest.append_new(stored, lines.filter(F.col("l_linestatus") == "O")).drop("l_linestatus")


def _rejected_rows(spark, sf):
    mapped = ingest.map_statements(star.statement_rows(spark, sf))
    return ingest.rejected(mapped)


def quarantine_rows(spark, sf):
    """The rejected rows of a load, staged once as the load job does, against a store of some of them."""
    bad = keep(_rejected_rows(spark, sf), "rejected", tempfile.gettempdir())
    stored = ingest.quarantine(bad.filter(F.col("type") == "Debit").filter(F.col("currency") == "usd"), None,
                               ["account", "date", "debit", "credit"])
    return ingest.quarantine(bad, stored, ["account", "date", "debit", "credit"]).select(
        "source", "reason", "raw", "fingerprint")


def quarantine_counts(spark, sf):
    stored = ingest.quarantine(_rejected_rows(spark, sf), None, ["account", "date", "debit", "credit", "descriptions"])
    return ingest.quarantine_summary(stored)


def _cursor(spark, sf):
    """A recorded cursor per customer, from all orders."""
    return star.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("account_id")).agg(
        F.max(F.to_date("o_orderdate")).alias("high_water"), F.date_add(F.min(F.to_date("o_orderdate")), 200).alias("coverage_start"))


def clip_dates(spark, sf):
    feed = star.categorized_sales(spark, sf)
    return ingest.clip_boundary(feed, _cursor(spark, sf))


def clip_statements(spark, sf):
    feed = star.categorized_sales(spark, sf)
    rows = star.income_ledger(spark, sf).select("id", "account_id", "booking_date")
    return ingest.clip_overlap(rows, ingest.clip_boundary(feed, _cursor(spark, sf)))


def clip_statements_whole(spark, sf):
    feed = star.categorized_sales(spark, sf)
    rows = star.income_ledger(spark, sf).select("id", "account_id", "booking_date")
    boundary = ingest.clip_boundary(feed, _cursor(spark, sf), keys=[])
    return ingest.clip_overlap(rows, boundary, keys=[])


def _pulls(spark, sf):
    return star.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("account_id"), F.lit(date(1996, 1, 1)).alias("since"),
        (F.col("c_mktsegment") == "BUILDING").alias("truncated"))


def cursor_advance(spark, sf):
    return ingest.advance_cursor(_cursor(spark, sf), star.sales_ledger(spark, sf), _pulls(spark, sf))


def next_pull(spark, sf):
    return ingest.pull_from(_cursor(spark, sf), date(1996, 1, 1), 5)


def ingest_counts(spark, sf):
    mapped = ingest.map_statements(star.statement_rows(spark, sf))
    feed = mapped.filter(F.col("booking_date") >= F.lit(date(2000, 1, 1)))
    mapped = ingest.clip_overlap(mapped, ingest.clip_boundary(feed.filter("status = 'ok'"), None))
    good = ingest.accepted(mapped).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    first = ingest.first_per_key(good, ["id"], [F.col("batch_ord"), F.col("file_path"), F.col("l_partkey")])
    return ingest.ingest_audit(mapped, first)


def combined_sources(spark, sf):
    both = ingest.combine(star.sales_ledger(spark, sf).drop("merchant_key"), star.income_ledger(spark, sf))
    return both.select("batch_id", "id", "account_id", "merchant_key", "amount_cents")


# ── merchants and categories ──────────────────────────────────────────────────

def _dressed_names(spark, sf):
    """Part names the way card statements write them, varied by size."""
    name, size = F.col("p_name"), F.col("p_size")
    raw = (
        F.when(size < 6, F.concat(F.lit("sumup *"), name, F.lit(" Dublin 2")))
        .when(size < 11, F.concat(F.lit("POS sq * "), name, F.lit("  4368 CORK")))
        .when(size < 16, F.concat(F.lit("VDP-"), F.substring_index(name, " ", -1), F.lit(" galway")))
        .when(size < 21, F.concat(F.lit(" "), name, F.lit(" { Type : x, At : 2026-05-04 }")))
        .when(size < 26, F.concat(name, F.lit(" 28jan 1/2/26 D04")))
        .when(size < 31, F.concat(F.lit("Apple.com/bill "), F.col("p_partkey").cast("string")))
        .when(size < 36, F.lit(""))
        .when(size < 41, F.concat(F.lit("zettle_PayPal *"), name, F.lit(" #12 IE")))
        .otherwise(name))
    return star.table(spark, sf, "part").select("p_partkey", "p_size", raw.alias("merchant_raw"))


def merchant_names(spark, sf):
    raw = F.col("merchant_raw")
    return _dressed_names(spark, sf).withColumns({
        "merchant_key": merchant_key(raw), "shown": display_name(raw), "identity": identity_name(raw)})


def _dressed_ledger(spark, sf):
    lines = star.table(spark, sf, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("booking_date"))
    return lines.join(_dressed_names(spark, sf), F.col("l_partkey") == F.col("p_partkey")).select(
        "booking_date", "merchant_raw")


def merchant_dimension(spark, sf):
    return merchants.build_merchants(_dressed_ledger(spark, sf))


def name_collisions(spark, sf):
    return merchants.key_collisions(_dressed_ledger(spark, sf))


def _name_labels(spark, sf):
    """Owner labels per product name: some valid, some stale, some outside the taxonomy."""
    name = F.col("p_name")
    names = star.table(spark, sf, "part").select("p_name").distinct()
    return names.select(
        F.when(name.startswith("hot "), name).otherwise(F.upper(name)).alias("merchant_key"),
        F.when(name.startswith("red "), "Nonsense").when(name.startswith("blue "), "Uncategorized")
        .when(name.startswith("small "), "Uncategorized").otherwise("Gifts").alias("category"),
        F.when(name.startswith("blue "), "manual").when(name.startswith("small "), "dict")
        .when(name.contains("gear"), "guess").otherwise("regex").alias("by"),
        F.when(name.contains("rod"), 0.5).alias("confidence"),
    )


def stale_labels(spark, sf):
    return merchants.stale_label_keys(_name_labels(spark, sf))


def rule_matches(spark, sf):
    keys = star.table(spark, sf, "part").select(F.upper("p_name").alias("merchant_key")).distinct()
    return keys.withColumn("category", cat.match_rules(F.col("merchant_key"), star.SALES_RULES))


def _rule_rows(spark, sf):
    """A table with a rule for every word of the benchmark, in several forms, some of them without an index entry."""
    words = star.table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("word"))
    word, ord_ = F.col("word"), F.col("ord")
    pattern = (
        F.when(ord_ % 16 == 5, F.concat(F.substring(word, 1, 2), F.lit("[.]?$")))
        .when(ord_ % 4 == 0, F.concat(F.lit("(^| )"), word, F.lit("( |[.,])")))
        .when(ord_ % 4 == 1, word)
        .when(ord_ % 4 == 2, F.concat(F.lit("^"), word, F.lit("|"), word, F.lit(" ?$")))
        .otherwise(F.concat(F.lit("("), word, F.lit("|XYZ"), word, F.lit(")E?[.,]"))))
    return words.select(F.upper("word").alias("word")).distinct().withColumn(
        "ord", F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long")).select(
            "ord", pattern.alias("pattern"), F.when(ord_ % 3 == 0, "Gifts").when(ord_ % 3 == 1, "Travel").otherwise("Cash").alias("category"))


def _spoken_names(spark, sf):
    """Whole conversation turns taken as merchant keys."""
    small, large = "abcdefghijklmnopqrstuvwxyz\n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    return star.table(spark, sf, "conversations").select(F.translate("text", small, large).alias("merchant_key")).distinct()


def rule_table_matches(spark, sf):
    """Categories by a table of rules that grows with the data, instead of a list in the plan."""
    found = cat.categorize(_spoken_names(spark, sf), None, _rule_rows(spark, sf))
    return found.select(F.md5("merchant_key").alias("key_md5"), "category", "categorized_by")


def rule_table_pairs(spark, sf):
    """How many names each rule of the table is found in."""
    numbered = _rule_rows(spark, sf).select(F.col("ord").alias("number"), "pattern")
    return patterns.matches(_spoken_names(spark, sf), numbered).groupBy(F.col("number").alias("ord")).agg(F.count("*").alias("names"))


def label_validity(spark, sf):
    return cat.usable_labels(_name_labels(spark, sf))


def _merchant_table(spark, sf):
    sales = star.sales_ledger(spark, sf)
    dims = sales.filter(F.col("merchant_key").isNotNull()).groupBy("merchant_key").agg(
        F.min("booking_date").alias("first_seen"))
    return cat.categorize(dims, _name_labels(spark, sf), star.SALES_RULES)


def cascade(spark, sf):
    return _merchant_table(spark, sf)


def cascade_counts(spark, sf):
    return cat.cascade_stats(_merchant_table(spark, sf))


def _overrides(spark, sf):
    """Large bookings the owner has set by hand."""
    sales = star.sales_ledger(spark, sf)
    return sales.filter(F.abs("amount_cents") > 9_500_000).select(
        F.col("id").alias("txn_id"), F.lit("Dates").alias("category"))


def effective_categories(spark, sf):
    ledger = star.sales_ledger(spark, sf)
    rows = cat.with_bucket(cat.categorized(ledger, _merchant_table(spark, sf), _overrides(spark, sf)))
    return rows.select("id", "merchant_key", "category", "bucket")


def bucket_rollup(spark, sf):
    return cat.with_bucket(_household(spark, sf)).groupBy("bucket", "category").agg(
        F.count("*").alias("rows"), F.sum("amount_cents").alias("cents"))


def category_coverage(spark, sf):
    return _rounded(cat.coverage(_household(spark, sf), AS_OF, accounts=star.accounts(spark, sf)), "count_pct", "value_pct")


def category_coverage_whole(spark, sf):
    return _rounded(cat.coverage(_household(spark, sf), AS_OF, 3_650, keys=[]), "count_pct", "value_pct")


def _requests(spark, sf):
    """Correction requests made in conversations: every turn names an event by part of its id."""
    turns = star.table(spark, sf, "conversations")
    number = F.col("conv_id") * 16 + F.col("turn")
    ident = F.sha2(number.cast("string"), 256)
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("role").alias("actor_id"),
        F.when(F.col("turn") == 0, F.substring(ident, 1, 8)).when(F.col("turn") == 1, F.concat(F.lit(" "), ident))
        .when(F.col("turn") == 2, F.substring(ident, 1, 5)).when(F.col("turn") == 3, F.upper(F.substring(ident, 1, 12)))
        .otherwise(F.substring(ident, 1, 12)).alias("ref"),
        F.when(F.col("role") == "user", " gifts ").when(F.col("role") == "system", "nothing")
        .otherwise("Coffee/snacks").alias("category"),
        (F.lit("2024-02-01").cast("timestamp") + F.make_interval(mins=F.col("turn").cast("int"))).alias("ts"))


def relabel_requests(spark, sf):
    return labels.resolve_labels(_requests(spark, sf), star.event_ledger(spark, sf)).drop("ts")


def _label_events(spark, sf):
    return labels.label_events(labels.resolve_labels(_requests(spark, sf), star.event_ledger(spark, sf)))


def relabel_events(spark, sf):
    actors = star.table(spark, sf, "conversations").select(F.col("role").alias("actor_id")).filter(
        F.col("actor_id") != "system").distinct()
    return labels.authorized(_label_events(spark, sf), actors).drop("ts")


def latest_labels(spark, sf):
    events = _label_events(spark, sf)
    return labels.latest_labels(events).select("merchant_key", "category", "by")


def latest_overrides(spark, sf):
    return labels.latest_overrides(_label_events(spark, sf))


EVENT_RULES = [Rule("^VIEW", "FoodDelivery"), Rule("^PURCHASE", "Groceries"), Rule("HOUSE$", "Shopping")]


def _dated_events(spark, sf):
    """Label events of all turns; the later ones are about single bookings only."""
    events = _label_events(spark, sf)
    late = F.col("ts") >= F.lit("2024-02-01 00:03:00").cast("timestamp")
    return events.filter(~late | (F.col("scope") == "txn")), events.filter(late & (F.col("scope") == "txn")), events.filter(~late)


def corrected_months(spark, sf):
    """A stored month cube after corrections, of which only the touched months and slots are counted anew."""
    ledger = star.event_ledger(spark, sf).drop("category")
    events, fresh, before = _dated_events(spark, sf)
    stored = refresh.month_cube(ledger, before, EVENT_RULES, slots=16)
    return refresh.corrected_cube(stored, ledger, events, fresh, EVENT_RULES, slots=16).drop("slot")


def single_overrides(spark, sf):
    return labels.override_one(_requests(spark, sf), star.event_ledger(spark, sf)).drop("ts")


def name_lookup(spark, sf):
    typed = star.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", " MISC. ").when(F.col("event_type") == "click", "coffee/SNACKS")
        .when(F.col("event_type") == "error", "food delivery").when(F.col("event_type") == "signup", "other")
        .otherwise("fixed").alias("name"))
    return cat.resolve_names(typed)


# ── spend ─────────────────────────────────────────────────────────────────────

def gross_spend(spark, sf):
    return spend.gross_spend(_household(spark, sf), *WINDOW).select("id", "account_id", "booking_date", "amount_cents", "category")


def net_scope(spark, sf):
    return spend.net_scope(_household(spark, sf), *WINDOW, THRESHOLD).select("id", "booking_date", "amount_cents", "category")


def trailing_rows(spark, sf):
    return spend.trailing(_household(spark, sf), AS_OF, 90).select("id", "booking_date", "amount_cents")


def category_pareto(spark, sf):
    return _rounded(spend.category_pareto(_household(spark, sf), *LONG_WINDOW), "pct", "cum_pct")


def category_pareto_whole(spark, sf):
    return _rounded(spend.category_pareto(_household(spark, sf), *WINDOW, keys=[]), "pct", "cum_pct")


def merchant_pareto(spark, sf):
    return _rounded(spend.merchant_pareto(_household(spark, sf), *LONG_WINDOW, top=3), "pct")


def merchant_pareto_whole(spark, sf):
    return _rounded(spend.merchant_pareto(_household(spark, sf), *LONG_WINDOW, keys=[]), "pct")


def size_bands(spark, sf):
    return spend.size_bands(star.event_ledger(spark, sf), date(2024, 1, 1), EVENTS_AS_OF, accounts=star.accounts(spark, sf))


def weekday_profile(spark, sf):
    return spend.weekday_profile(_household(spark, sf), *WINDOW, accounts=star.accounts(spark, sf))


def daily_spend(spark, sf):
    return spend.daily_spend(_household(spark, sf), *LONG_WINDOW)


def burn_rate(spark, sf):
    return _rounded(spend.burn_rate(_household(spark, sf), *WINDOW, 10_000_000), "even_spend_cents")


def spend_totals(spark, sf):
    return spend.spend_total(_household(spark, sf), *WINDOW, accounts=star.accounts(spark, sf))


def bucket_spend(spark, sf):
    return spend.spend_by_bucket(_household(spark, sf), *WINDOW, threshold=THRESHOLD, accounts=star.accounts(spark, sf))


def held_inflows(spark, sf):
    return spend.unlabeled_inflows(_household(spark, sf), *LONG_WINDOW, threshold=THRESHOLD)


def month_over_month(spark, sf):
    return spend.month_over_month(_household(spark, sf), AS_OF, threshold=THRESHOLD)


def month_surplus(spark, sf):
    return spend.month_surplus(_household(spark, sf), threshold=THRESHOLD)


def surplus_target(spark, sf):
    return spend.surplus_vs_target(_household(spark, sf), AS_OF, threshold=THRESHOLD, accounts=star.accounts(spark, sf))


def bucket_breakdown(spark, sf):
    return spend.bucket_breakdown(_household(spark, sf), "Other", AS_OF)


def weekly_digest(spark, sf):
    return spend.weekly_digest(star.event_ledger(spark, sf), EVENTS_AS_OF, threshold=1_000)


def top_movers(spark, sf):
    return spend.top_movers(spend.weekly_digest(star.event_ledger(spark, sf), EVENTS_AS_OF, threshold=1_000))


def top_spends(spark, sf):
    return spend.top_spends(star.event_ledger(spark, sf), EVENTS_AS_OF)


def latest_in_category(spark, sf):
    return spend.latest_in_category(star.event_ledger(spark, sf), "Groceries", EVENTS_AS_OF, n=4)


# ── reconciliation ────────────────────────────────────────────────────────────

def reconciliation(spark, sf):
    return recon.reconciliation(_household(spark, sf), *LONG_WINDOW)


def reconciliation_whole(spark, sf):
    return recon.reconciliation(_household(spark, sf), EPOCH, AS_OF, keys=[])


def gate_verdict(spark, sf):
    return recon.gate_verdict(recon.reconciliation(_household(spark, sf), *LONG_WINDOW))


def budget_baseline(spark, sf):
    return recon.budget_baseline(recon.reconciliation(_household(spark, sf), *LONG_WINDOW))


# ── pay cycle ─────────────────────────────────────────────────────────────────

def _payday_overrides(spark, sf):
    """Logged paydays: the days orders were placed."""
    orders = star.table(spark, sf, "orders")
    reports = orders.select(
        F.col("o_custkey").cast("string").alias("account_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"),
        (F.lit("2002-01-01").cast("timestamp") + F.make_interval(mins=F.col("o_orderkey").cast("int"))).alias("ts"))
    return cycle.log_paydays(reports, AS_OF, 31)


def _accounts(spark, sf):
    return star.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("account_id"))


def payday_months(spark, sf):
    return _payday_overrides(spark, sf).select("account_id", "cycle_month", "actual_date")


def payday_calendar(spark, sf):
    calendar = cycle.payday_calendar(_accounts(spark, sf), date(2001, 1, 1), date(2001, 8, 1), 31)
    return cycle.apply_overrides(calendar, _payday_overrides(spark, sf))


def pay_cycles(spark, sf):
    calendar = cycle.payday_calendar(_accounts(spark, sf), date(2001, 1, 1), date(2001, 8, 1), 31)
    return cycle.cycles(cycle.apply_overrides(calendar, _payday_overrides(spark, sf)))


def cycle_spend(spark, sf):
    calendar = cycle.payday_calendar(_accounts(spark, sf), date(2000, 1, 1), date(2001, 8, 1), 23)
    table = cycle.cycles(cycle.apply_overrides(calendar, _payday_overrides(spark, sf)))
    return cycle.spend_per_cycle(_household(spark, sf), table, threshold=THRESHOLD)


def safe_to_spend(spark, sf):
    return cycle.safe_to_spend(_household(spark, sf), AS_OF, POOL_CENTS, accounts=_accounts(spark, sf),
                               overrides=_payday_overrides(spark, sf), threshold=THRESHOLD)


def account_status(spark, sf):
    held = ingest.quarantine(_rejected_rows(spark, sf), None, ["account", "date", "debit", "credit"]).withColumn(
        "account_id", F.substring("account_id", 5, 1))
    return cycle.account_status(_household(spark, sf), AS_OF, POOL_CENTS, quarantine=held,
                                accounts=_accounts(spark, sf), threshold=THRESHOLD)


def account_status_whole(spark, sf):
    return cycle.account_status(_household(spark, sf), AS_OF, POOL_CENTS * 400, keys=[], threshold=THRESHOLD)


def weekly_plan(spark, sf):
    status = cycle.account_status(_household(spark, sf), AS_OF, POOL_CENTS, threshold=THRESHOLD,
                                  accounts=star.accounts(spark, sf))
    return cycle.weekly_plan(status).select(
        "account_id", "days_left", "weeks_left", "remaining_cents", "week_budget_cents", "weekly_rail_cents", "light")


# ── caps, bills, recurring ────────────────────────────────────────────────────

def policy_matches(spark, sf):
    rows = policy.match_policies(star.event_ledger(spark, sf), POLICIES)
    return rows.select("batch_ord", "ord", "policy", "cap_cents", "is_first")


def policy_progress(spark, sf):
    return policy.policy_progress(star.event_ledger(spark, sf), POLICIES, threshold=1_000).select(
        "batch_ord", "account_id", "ord", "mtd_cents", "charge_number")


def _bucketed_events(spark, sf):
    return keep_bucketed(star.event_ledger(spark, sf), "events", tempfile.gettempdir(), ["account_id"], 8)


def bucketed_progress(spark, sf):
    """The running totals of `policy_progress` over a copy in buckets by account."""
    return policy.policy_progress(_bucketed_events(spark, sf), POLICIES, threshold=1_000, hot_rows=None).select(
        "batch_ord", "account_id", "ord", "mtd_cents", "charge_number")


def bucketed_recurring(spark, sf):
    return recurring.detect_recurring(_bucketed_events(spark, sf), EVENTS_AS_OF, EVENT_LIMITS)


def policy_progress_hot(spark, sf):
    """The running totals of `policy_progress` with every group cut, and rows without an account or a batch."""
    rows = star.event_ledger(spark, sf).withColumns({
        "account_id": F.when(F.col("batch_ord") % 3 != 0, F.col("account_id")),
        "batch_id": F.when(F.col("batch_ord") % 2 == 0, F.col("batch_id"))})
    return policy.policy_progress(rows, POLICIES, threshold=1_000, block_rows=50, hot_rows=1).select(
        "batch_ord", "account_id", "ord", "mtd_cents", "charge_number")


def policy_alerts(spark, sf):
    return policy.policy_alerts(star.event_ledger(spark, sf), POLICIES, threshold=1_000)


def _loads(spark, sf):
    """Events as two loads; the second holds late rows of every day."""
    late = F.col("batch_ord") % 4 == 0
    events = star.event_ledger(spark, sf).withColumn("batch_id", F.when(late, "load-2").otherwise("load-1"))
    return events.filter(~late), events.filter(late)


def kept_alerts(spark, sf):
    """Alerts of the second load from the kept sums of the first."""
    before, late = _loads(spark, sf)
    return progress.alerts_from_state(late, progress.progress_sums(before, POLICIES, threshold=1_000), POLICIES, threshold=1_000)


def kept_sums(spark, sf):
    """The state after both loads."""
    return progress.merged_sums(*[progress.progress_sums(load, POLICIES, threshold=1_000) for load in _loads(spark, sf)]).drop("month")


def policy_alerts_whole(spark, sf):
    return policy.policy_alerts(star.event_ledger(spark, sf), POLICIES, EVENTS_AS_OF, keys=[], threshold=1_000).drop("text")


def _own_policies(spark, sf):
    """A table of caps in which accounts differ in what they cap, how often and at what."""
    key = F.col("c_custkey")
    none = F.lit(None).cast("string")

    def row(ord_, name, cap, when, bucket=none, sub_label=none, pattern=none):
        return F.when(when, F.struct(
            F.lit(ord_).cast("long").alias("ord"), F.lit(name).alias("policy"), cap.cast("long").alias("cap_cents"),
            bucket.alias("bucket"), sub_label.alias("sub_label"), pattern.alias("pattern")))

    labels_ = F.when(key % 3 == 0, "Groceries").when(key % 3 == 1, "FoodDelivery").otherwise("Coffee/Snacks")
    names = F.when(key % 2 == 0, "^(VIEW|PURCHASE) HOUSE$").otherwise("CLICK|SIGNUP HOUSE$")
    rows = F.array_compact(F.array(
        row(0, "label-cap", 500 + key % 7 * 300, F.lit(True), sub_label=labels_),
        row(1, "name-cap", 1_000 + key % 5 * 500, F.lit(True), pattern=names),
        row(2, "bucket-cap", F.lit(2_000), key % 4 != 1, bucket=F.lit("Other")),
        row(3, "tail-cap", F.lit(1_500), key % 5 == 0, pattern=F.lit("E$"))))
    return star.table(spark, sf, "customer").select(key.cast("string").alias("account_id"), F.inline(rows))


def own_policy_matches(spark, sf):
    rows = policy.match_policies(star.event_ledger(spark, sf), _own_policies(spark, sf))
    return rows.select("batch_ord", "ord", "policy", "cap_cents", "is_first")


def own_policy_alerts(spark, sf):
    return policy.policy_alerts(star.event_ledger(spark, sf), _own_policies(spark, sf), threshold=1_000)


def alerts_unsent(spark, sf):
    events = star.event_ledger(spark, sf)
    fresh = events.filter(F.col("booking_date") >= F.lit(date(2024, 1, 20)))
    alerts = policy.policy_alerts(events, POLICIES, new_ids=fresh, threshold=1_000).select(
        F.lit("policy_alert").alias("kind"), F.col("id").alias("subject_id"), "account_id", "policy", "mtd_cents")
    log = events.filter(F.col("merchant_key") == "PURCHASE HOUSE").select(
        F.lit("policy_alert").alias("kind"), F.col("id").alias("subject_id"))
    return policy.unsent(alerts, log)


def rows_since_mark(spark, sf):
    daily = star.event_ledger(spark, sf).withColumn("batch_id", F.col("booking_date").cast("string"))
    return policy.new_since(daily, "2024-01-20").select("batch_ord", "account_id", "amount_cents")


def current_dues(spark, sf):
    orders = star.table(spark, sf, "orders")
    as_of = F.to_date("o_orderdate")
    due_day = F.pmod(F.col("o_orderkey"), F.lit(31)).cast("int") + 1
    return orders.select(
        "o_orderkey", bill_ops.current_due(as_of, due_day).alias("due"),
        day_in_month(month_start(as_of), due_day).alias("this_month"), iso_week_key(as_of).alias("iso_week"))


def bill_matches(spark, sf):
    return bill_ops.match_bills(star.event_ledger(spark, sf), BILLS, EVENTS_AS_OF)


def _bill_state(spark, sf):
    return bill_ops.bill_state(star.event_ledger(spark, sf), BILLS, EVENTS_AS_OF)


def bill_alerts(spark, sf):
    return bill_ops.bill_alerts(_bill_state(spark, sf))


def bill_alerts_unsent(spark, sf):
    """Bill alerts that a log of all late ones, and of a half of the others, lacks."""
    alerts = bill_ops.bill_alerts(_bill_state(spark, sf))
    log = alerts.filter((F.col("kind") == "late") | F.col("account_id").cast("long").bitwiseAND(1).cast("boolean"))
    return policy.unsent(alerts, log, ["account_id", "period_key"]).select("account_id", "bill", "kind", "due", "period_key")


def bill_checklist(spark, sf):
    return bill_ops.bill_checklist(_bill_state(spark, sf))


def _own_bills(spark, sf):
    """A table of bills in which accounts differ, each looked at on three days."""
    key = F.col("c_custkey")

    def row(name, pattern, due_day, expected, tolerance, when):
        return F.when(when, F.struct(
            F.lit(name).alias("bill"), F.lit(pattern).alias("pattern"), due_day.cast("int").alias("due_day"),
            expected.cast("long").alias("expected_cents"), F.lit(tolerance).alias("tolerance_pct")))

    rows = F.array_compact(F.array(
        row("Box", "^PURCHASE", key % 31 + 1, 900 + key % 10 * 50, 20, F.lit(True)),
        row("View", r"\bHOUSE$", F.lit(31), F.lit(500), 50, key % 2 == 0),
        row("Any", "[KW] HOUS?E$", F.lit(5), F.lit(1_000), 10, key % 3 == 0)))
    days = F.array(*[F.lit(date(2024, 1, d)) for d in (10, 25, 31)])
    return star.table(spark, sf, "customer").select("c_custkey", F.explode(days).alias("as_of")).select(
        key.cast("string").alias("account_id"), "as_of", F.inline(rows))


def own_bill_states(spark, sf):
    return bill_ops.own_bill_state(star.event_ledger(spark, sf), _own_bills(spark, sf))


def own_bill_alerts(spark, sf):
    return bill_ops.bill_alerts(own_bill_states(spark, sf), ["account_id", "as_of"])


def charge_gaps(spark, sf):
    return recurring.charge_gaps(star.event_ledger(spark, sf))


def recurring_charges(spark, sf):
    return recurring.detect_recurring(star.event_ledger(spark, sf), EVENTS_AS_OF, EVENT_LIMITS)


def _event_loads(spark, sf):
    events = star.event_ledger(spark, sf)
    late = F.col("batch_ord") % 3 == 1
    return events.filter(~late), events.filter(late)


def recurring_kept(spark, sf):
    """Recurring charges from the merged states of two loads."""
    first, second = _event_loads(spark, sf)
    maps = rhythm.merged_maps(rhythm.month_maps(first), rhythm.month_maps(second))
    amounts = rhythm.merged_amounts(rhythm.month_amounts(first), rhythm.month_amounts(second))
    return rhythm.recurring_from_maps(maps, amounts, EVENTS_AS_OF, EVENT_LIMITS)


def charge_maps(spark, sf):
    """The state itself: days as bits, and sums that merge."""
    first, second = _event_loads(spark, sf)
    return rhythm.merged_maps(rhythm.month_maps(first), rhythm.month_maps(second)).withColumn("squares", F.col("squares").cast("long"))


def recurring_totals(spark, sf):
    return recurring.recurring_summary(recurring_charges(spark, sf))


# ── stream transformations on tables ──────────────────────────────────────────

def daily_windows(spark, sf):
    return windows.daily_spend_stream(star.event_ledger(spark, sf))


def weekly_windows(spark, sf):
    return windows.weekly_spend_stream(star.event_ledger(spark, sf))


def deduped_events(spark, sf):
    events = star.event_ledger(spark, sf).select("id", "account_id", "amount_cents")
    return windows.dedupe_stream(events.unionByName(events))


def emitted_once(spark, sf):
    events = star.event_ledger(spark, sf)
    due = events.select("account_id", F.col("booking_date").alias("as_of")).distinct()
    log = events.filter(F.col("category") == "Groceries").select(
        "account_id", F.lit("weekly_plan").alias("kind"), iso_week_key(F.col("booking_date")).alias("period_key"))
    return windows.once_per(due, "weekly_plan", "week", log)


# ── text scans ────────────────────────────────────────────────────────────────

def secret_shapes(spark, sf):
    return scan.scan_shapes(star.table(spark, sf, "documents"), "text")


def secret_flags(spark, sf):
    flagged = scan.flag_shapes(star.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return flagged.drop("text")


def pattern_hits(spark, sf):
    return scan.scan_patterns(star.table(spark, sf, "documents"), "text", PATTERN_LINES).select("doc_id", "lang")


def redacted_texts(spark, sf):
    clean = scan.redact(star.table(spark, sf, "documents").select("doc_id", "text"), "text", REDACT)
    return clean.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"))


QUERIES = {
    f.__name__: f for f in (
        money_parse, date_parse, statement_map, feed_map, booked_rows, row_contract, currency_gate, account_labels,
        row_ids, append_once, quarantine_rows, quarantine_counts, clip_dates, clip_statements,
        clip_statements_whole, row_ids_hot, feed_rejects, long_names, cursor_advance, next_pull, ingest_counts, combined_sources,
        merchant_names, merchant_dimension, name_collisions, stale_labels, rule_matches, rule_table_matches, rule_table_pairs, label_validity, cascade,
        cascade_counts, effective_categories, bucket_rollup, category_coverage, category_coverage_whole,
        relabel_requests, relabel_events, latest_labels, latest_overrides, single_overrides, corrected_months, name_lookup,
        gross_spend, net_scope, trailing_rows, category_pareto, category_pareto_whole, merchant_pareto,
        merchant_pareto_whole, size_bands, weekday_profile, daily_spend, burn_rate, spend_totals, bucket_spend,
        held_inflows, month_over_month, month_surplus, surplus_target, bucket_breakdown, weekly_digest, top_movers,
        top_spends, latest_in_category, reconciliation, reconciliation_whole, gate_verdict, budget_baseline,
        payday_months, payday_calendar, pay_cycles, cycle_spend, safe_to_spend, account_status,
        account_status_whole, weekly_plan, policy_matches, policy_progress, policy_progress_hot, bucketed_progress, bucketed_recurring, policy_alerts, policy_alerts_whole,
        own_policy_matches, own_policy_alerts, kept_alerts, kept_sums, own_bill_states, own_bill_alerts,
        alerts_unsent, rows_since_mark, current_dues, bill_matches, bill_alerts, bill_alerts_unsent, bill_checklist, charge_gaps,
        recurring_charges, recurring_totals, recurring_kept, charge_maps, daily_windows, weekly_windows, deduped_events, emitted_once,
        secret_shapes, secret_flags, pattern_hits, redacted_texts,
    )
}
