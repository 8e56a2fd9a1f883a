"""Merchant dimension: one row per key, with the checks that go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import DEFAULT_NAME_RULES, NameRules, identity_name, merchant_key


def with_merchant_key(ledger: DataFrame, rules: NameRules = DEFAULT_NAME_RULES) -> DataFrame:
    """Add `merchant_key`; null when there is no name. Ingest stores it, so reports need not repeat it."""
    key = merchant_key(F.col("merchant_raw"), rules)
    return ledger.withColumn("merchant_key", F.when(key != "", key))


def raw_names(ledger: DataFrame, rules: NameRules = DEFAULT_NAME_RULES) -> DataFrame:
    """Distinct raw names with their key and first date: names are cleaned once each, not per row."""
    distinct = (
        ledger.filter(F.col("merchant_raw").isNotNull())
        .groupBy("merchant_raw").agg(F.min("booking_date").alias("first_seen"))
    )
    return with_merchant_key(distinct, rules).filter(F.col("merchant_key").isNotNull())


def build_merchants(ledger: DataFrame, rules: NameRules = DEFAULT_NAME_RULES) -> DataFrame:
    """One row per merchant key with the earliest date any spelling of it was seen."""
    return (
        raw_names(ledger, rules)
        .groupBy("merchant_key").agg(F.min("first_seen").alias("first_seen"))
    )


def key_collisions(ledger: DataFrame, rules: NameRules = DEFAULT_NAME_RULES) -> DataFrame:
    """Keys reached from more than one name, with how many names and the first and last of them.

    The spellings are counted, not gathered: a key that swallows millions of names stays one row.
    """
    names = (
        raw_names(ledger, rules)
        .select("merchant_key", identity_name(F.col("merchant_raw")).alias("name")).distinct()
    )
    return (
        names.groupBy("merchant_key")
        .agg(F.count("*").alias("names"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))
        .filter(F.col("names") > 1)
    )


def stale_label_keys(labels: DataFrame, rules: NameRules = DEFAULT_NAME_RULES) -> DataFrame:
    """Labels whose key is not in normal form, so no merchant can ever match them."""
    return labels.filter(merchant_key(F.col("merchant_key"), rules) != F.col("merchant_key"))
