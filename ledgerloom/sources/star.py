"""Ledgers over the sales and event tables the queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT_TAXONOMY, Rule
from ledgerloom.functions.dates import month_key
from ledgerloom.operators.categorize import categorize, categorized
from ledgerloom.operators.merchants import with_merchant_key

# Product nouns as spending categories; one noun is left out so that something stays uncategorized.
SALES_RULES = [
    Rule(r"\bPLATE$", "Groceries"), Rule(r"\bROD$", "Rent"), Rule(r"\bGEAR$", "Transport"),
    Rule(r"\bGIZMO$", "FoodDelivery"), Rule(r"\bWIDGET$", "Tools"), Rule(r"\bRING$", "Coffee/Snacks"),
    Rule(r"\bBOLT$", "Utilities"), Rule(r"^SALARY\b", "Income"), Rule(r"^HOUSE TRANSFER$", "Transfers"),
    Rule(r"E$", "Shopping"),
]
EVENT_CATEGORIES = {"purchase": "Groceries", "view": "FoodDelivery", "click": "Coffee/Snacks"}


# Given schemas, so that building a query opens no file.
SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id string, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def named_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as merchants. Names are cleaned here, once per part and not per sale."""
    raw = F.concat(F.lit("POS "), F.upper("p_name"), F.lit(" "), F.col("p_partkey").cast("string"))
    parts = table(spark, folder, "part").select(
        "p_partkey", F.when(F.col("p_brand") != "Brand#13", raw).alias("merchant_raw"))
    return with_merchant_key(parts)


def part_merchants(spark: SparkSession, folder: str) -> DataFrame:
    """Merchant keys of the parts with the category the rules give them."""
    keys = named_parts(spark, folder).select("merchant_key").filter(F.col("merchant_key").isNotNull()).distinct()
    return categorize(keys, None, SALES_RULES)


def sales_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item as a booking of its customer; returns come back as inflows."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag",
        F.to_date("l_shipdate").alias("booking_date"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("account_id"))
    price = cents(F.col("l_extendedprice"))
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(named_parts(spark, folder), lines.l_partkey == F.col("p_partkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", price).alias("id"), "account_id",
            "booking_date", F.when(F.col("l_returnflag") == "R", price).otherwise(-price).alias("amount_cents"),
            "merchant_raw", "merchant_key", F.lit("sales").alias("batch_id"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("batch_ord"))
    )


def categorized_sales(spark: SparkSession, folder: str) -> DataFrame:
    return categorized(sales_ledger(spark, folder), part_merchants(spark, folder))


def income_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a booking that is no sale: salaries, fees, bonuses, and transfers in or, when final, out."""
    price, kind = cents(F.col("o_totalprice")), F.substring("o_orderpriority", 1, 1)

    def named(first: str, second: str, third: str, other: str) -> Column:
        return F.when(kind == "1", first).when(kind == "2", second).when(kind == "3", third).otherwise(other)

    name = named("SALARY", "BANK FEE", "BONUS", "HOUSE TRANSFER")
    amount = F.when(kind == "2", -F.call_function("div", price, F.lit(1000))).when(
        kind.isin("4", "5") & (F.col("o_orderstatus") == "F"), -price).otherwise(price)
    return table(spark, folder, "orders").select(
        F.concat(F.lit("order-"), "o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("account_id"),
        F.to_date("o_orderdate").alias("booking_date"), amount.alias("amount_cents"), name.alias("merchant_raw"),
        name.alias("merchant_key"), named("Income", "Fees", "Income", "Transfers").alias("category"),
        F.lit("income").alias("batch_id"), F.col("o_orderkey").alias("batch_ord"))


def household_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Sales and income of every customer as one categorized ledger."""
    return categorized_sales(spark, folder).unionByName(income_ledger(spark, folder))


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer, with or without a booking."""
    return table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("account_id"))


def event_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Events as small bookings of their user; sign-ups and tiny values flow in."""
    value, kind = cents(F.col("value")), F.col("event_type")
    inflow = (kind == "signup") | (F.col("value") < 2)
    category = F.coalesce(*[F.when(kind == k, c) for k, c in EVENT_CATEGORIES.items()],
                          F.lit(DEFAULT_TAXONOMY.uncategorized))
    return table(spark, folder, "events").select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("id"), F.col("user_id").cast("string").alias("account_id"),
        F.to_date("ts").alias("booking_date"), F.col("ts").alias("booking_ts"),
        F.when(inflow, value).otherwise(-value).alias("amount_cents"),
        F.concat(F.lit("SUMUP *"), kind, F.lit(" house")).alias("merchant_raw"),
        F.concat(F.upper(kind), F.lit(" HOUSE")).alias("merchant_key"), category.alias("category"),
        F.lit("events").alias("batch_id"), F.col("event_id").alias("batch_ord"),
        month_key(F.col("ts")).alias("booking_month"))


def statement_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items written out as statement text, broken in the ways statements are, by quantity."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    qty, money = F.col("l_quantity"), F.format_number("l_extendedprice", 2)
    amount = (
        F.when(qty == 3, F.replace(money, F.lit(","), F.lit("."))).when(qty == 5, "0.00").when(qty == 9, "")
        .when(qty == 15, F.concat(F.lit(" €"), money)).otherwise(money))
    day = F.col("l_shipdate")
    returned = F.col("l_returnflag") == "R"
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            "l_orderkey", "l_linenumber", "l_partkey",
            F.when(qty == 13, " ").otherwise(F.concat(F.lit("ACC-"), "o_orderpriority")).alias("account"),
            F.when(qty == 7, "soon").when(F.col("l_linenumber") == 1, F.date_format(day, "dd/MM/yyyy"))
            .when(F.col("l_linenumber") == 2, F.date_format(day, "yyyy-MM-dd"))
            .otherwise(F.date_format(day, "dd/MM/yy")).alias("date"),
            F.when(returned, "").otherwise(amount).alias("debit"),
            F.when(returned, amount).when(qty == 21, "1.00").otherwise("").alias("credit"),
            F.when(qty == 11, "Pending card").otherwise("Debit").alias("type"),
            F.when(qty == 17, "usd").when(qty == 19, " eur ").alias("currency"),
            F.array(F.concat(F.lit(" "), "p_name", F.lit(" ")), F.lit(""), F.concat(F.lit("no "), "l_partkey"))
            .alias("descriptions"),
            F.concat(F.lit("file-"), F.col("l_suppkey")).alias("file_path"),
            F.concat(F.lit("file-"), F.col("l_suppkey")).alias("batch_id"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("batch_ord"))
    )


def feed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as bank-feed records, some pending, undated, unsigned, foreign or unreadable."""
    kind, value = F.col("event_type"), F.col("value")
    amount = F.when(value.between(33, 36), F.concat(F.lit("x"), value.cast("string"))).otherwise(F.format_number(value, 2))
    day = F.date_format("ts", "yyyy-MM-dd")
    other = F.struct(F.when(kind != "error", F.concat(kind, F.lit(" shop"))).alias("name"))
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("account_id"),
        F.when(value > 1, F.concat(F.lit("ref-"), "event_id")).alias("entry_reference"),
        F.when(value < 40, F.when(value > 39, "2024-13-01").otherwise(day)).alias("booking_date"),
        F.when(value < 50, day).alias("value_date"),
        F.struct(amount.alias("amount"), F.when(value > 30, "usd").when(value > 20, "eur").alias("currency"))
        .alias("transaction_amount"),
        F.when(kind == "signup", "CRDT").when((kind != "view") | (value < 10), "dbit").alias("credit_debit_indicator"),
        F.when(kind == "click", F.when(value > 5, "PDNG").otherwise("booked")).alias("status"),
        other.alias("creditor"), other.alias("debtor"),
        F.when(value < 15, F.concat(F.lit('[" paid", "", "'), kind, F.lit('"]'))).otherwise(kind)
        .alias("remittance_information"),
        F.lit("events").alias("file_path"), F.lit("events").alias("batch_id"), F.col("event_id").alias("batch_ord"))
