"""Corrections that rewrite only what they touch.

The month cube holds, for each account, month and category, what the reports are made of. It is stored in partitions by
month and slot, a hash of the account. New label events lead to merchants and bookings, these to partitions, and
only those partitions are counted anew and replaced; the files of all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT_TAXONOMY, Rule, Taxonomy
from ledgerloom.operators.categorize import categorize, categorized
from ledgerloom.operators.labels import latest_labels, latest_overrides
from ledgerloom.operators.spend import KEYS, spent
from ledgerloom.sources.tables import keep, write_table

SLOTS = 64
PARTS = ["booking_month", "slot"]


def slot_of(keys: list[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int") if keys else F.lit(0)


def with_slot(ledger: DataFrame, keys: list[str] = KEYS, slots: int = SLOTS) -> DataFrame:
    return ledger.withColumn("slot", slot_of(keys, slots))


def touched_parts(events: DataFrame, ledger: DataFrame, keys: list[str] = KEYS, slots: int = SLOTS) -> DataFrame:
    """Months and slots with a booking that the events are about, of its merchant or itself."""
    rows = with_slot(ledger, keys, slots).select("id", "merchant_key", *PARTS)
    merchants = events.filter("scope = 'merchant'").select("merchant_key").distinct()
    bookings = events.filter("scope = 'txn'").select(F.col("txn_id").alias("id")).distinct()
    return rows.join(merchants, "merchant_key", "left_semi").select(*PARTS).unionByName(
        rows.join(bookings, "id", "left_semi").select(*PARTS)).distinct()


def month_cube(ledger: DataFrame, events: DataFrame, rules: list[Rule] | DataFrame, keys: list[str] = KEYS, slots: int = SLOTS,
               parts: DataFrame | None = None, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Bookings, net cents, charges and their cents by keys, month and category, as all label events so far have it.

    With `parts` only for those months and slots: the months prune partitions of the ledger, and names and labels are looked
    up only for the merchants found there.
    """
    rows = with_slot(ledger, keys, slots)
    if parts is not None:
        rows = rows.join(parts, PARTS, "left_semi")
    names = rows.select("merchant_key").filter(F.col("merchant_key").isNotNull()).distinct()
    sorted_out = categorized(rows, categorize(names, latest_labels(events), rules, taxonomy), latest_overrides(events), taxonomy)
    charge = F.col("amount_cents") < 0
    return sorted_out.groupBy(*keys, *PARTS, "category").agg(
        F.count("*").alias("bookings"), F.sum("amount_cents").alias("cents"), F.count_if(charge).alias("charges"),
        F.coalesce(F.sum(F.when(charge, spent())), F.lit(0)).alias("charged_cents"))


def write_cube(cube: DataFrame, path: str) -> None:
    """Write partitions of the cube, replacing those that are there; one file for each."""
    write_table(cube.repartition(*PARTS), path, "overwrite", PARTS)


def corrected_cube(stored: DataFrame, ledger: DataFrame, events: DataFrame, fresh: DataFrame, rules: list[Rule] | DataFrame,
                   keys: list[str] = KEYS, slots: int = SLOTS, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """The cube after new events as a table: stored partitions that they do not touch, and the others counted anew."""
    parts = touched_parts(fresh, ledger, keys, slots)
    anew = month_cube(ledger, events, rules, keys, slots, parts, taxonomy)
    return stored.join(parts, PARTS, "left_anti").unionByName(anew)


def correct_cube(path: str, ledger: DataFrame, events: DataFrame, fresh: DataFrame, rules: list[Rule] | DataFrame, work: str,
                 keys: list[str] = KEYS, slots: int = SLOTS, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> None:
    """Replace the touched partitions of a stored cube. `events` are all events, `fresh` those since the last call.

    Running it again gives the same tables. The touched parts are written first, so they are found once and Spark knows their size.
    """
    parts = keep(touched_parts(fresh, ledger, keys, slots), "touched", work)
    write_cube(month_cube(ledger, events, rules, keys, slots, parts, taxonomy), path)
