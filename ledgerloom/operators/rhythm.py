"""Recurring charges from a kept state, without reading the history again.

The state has a row for each account, merchant and month: the days with a charge as 31 bits, and counts, sums and sums of
squares; and one for each amount of a month, for the medians. Both merge by adding up, in any order. Gaps between
charges are read off the days. What a batch brings is added to the months it touches.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import month_start
from ledgerloom.operators.recurring import RecurringLimits, charges_of, rhythm
from ledgerloom.operators.spend import KEYS, spent

WIDE = "decimal(38,0)"


def _added(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys, "merchant_key", "month").agg(*[value.alias(name) for name, value in columns.items()])


def month_maps(ledger: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, merchant_key, month, days (bit 0 is the first), charges, cents, squares, first_seen, from rows of the ledger.

    Months in which a merchant has only inflows count for first_seen alone.
    """
    charge = F.col("amount_cents") < 0
    bit = F.call_function("shiftleft", F.lit(1), F.dayofmonth("booking_date") - 1)
    rows = ledger.filter(F.col("merchant_key").isNotNull()).withColumn("month", month_start(F.col("booking_date")))
    return _added(rows, keys, {
        "days": F.coalesce(F.bit_or(F.when(charge, bit)), F.lit(0)), "charges": F.count_if(charge),
        "cents": F.coalesce(F.sum(F.when(charge, spent())), F.lit(0)),
        "squares": F.coalesce(F.sum(F.when(charge, spent().cast("decimal(19,0)") * spent())), F.lit(0)).cast(WIDE),
        "first_seen": F.min("booking_date")})


def month_amounts(ledger: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, merchant_key, month, spend and how many charges have that amount."""
    rows = charges_of(ledger, None).withColumns({"month": month_start(F.col("booking_date")), "spend": spent()})
    return rows.groupBy(*keys, "merchant_key", "month", "spend").agg(F.count("*").alias("charges"))


def merged_maps(first: DataFrame, second: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return _added(first.unionByName(second), keys, {
        "days": F.bit_or("days"), "charges": F.sum("charges"), "cents": F.sum("cents"), "squares": F.sum("squares").cast(WIDE),
        "first_seen": F.min("first_seen")})


def merged_amounts(first: DataFrame, second: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return first.unionByName(second).groupBy(*keys, "merchant_key", "month", "spend").agg(F.sum("charges").alias("charges"))


def _dates(month: Column, days: Column) -> Column:
    marked = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda i: F.getbit(days.cast("long"), i) == 1)
    return F.transform(marked, lambda i: F.date_add(month, i))


def recurring_from_maps(maps: DataFrame, amounts: DataFrame, as_of: date, limits: RecurringLimits = RecurringLimits(),
                        keys: list[str] = KEYS) -> DataFrame:
    """`recurring.detect_recurring` over all that has been added to the state.

    A merchant's months are gathered into one row; they are no more than the calendar has. Amounts are read for merchants with
    a steady rhythm only, and their median is found among counted amounts.
    """
    by = [*keys, "merchant_key"]
    n, total = F.sum("charges"), F.sum("cents")
    variance = n.cast(WIDE) * F.sum("squares") - total.cast("decimal(19,0)") * total
    stats = maps.groupBy(*by).agg(
        n.alias("occurrences"), F.try_divide(total, n).alias("_mean"), F.try_divide(F.sqrt(variance.cast("double")), n).alias("_sd"),
        F.array_sort(F.flatten(F.collect_list(_dates(F.col("month"), F.col("days"))))).alias("_days"),
        F.min("first_seen").alias("first_seen")).withColumn("_last", F.array_max("_days"))
    live = rhythm(stats, as_of, limits, [*by, "first_seen"])
    counted = amounts.join(live.select(*by), by, "left_semi").groupBy(*by, "spend").agg(F.sum("charges").alias("charges"))
    middle = counted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("spend", "charges"))).alias("_list"), F.sum("charges").alias("_n"))
    up_to = F.aggregate(
        "_list", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("median")),
        lambda a, x: F.struct((a["seen"] + x["charges"]).alias("seen"), F.coalesce(
            a["median"], F.when(2 * (a["seen"] + x["charges"]) >= F.col("_n"), x["spend"])).alias("median")))
    found = middle.select(*by, up_to["median"].alias("amount_cents"))
    per_year = F.when(F.col("period") == "monthly", 12).otherwise(52)
    return live.join(found, by).withColumn("annualized_cents", F.col("amount_cents") * per_year)
