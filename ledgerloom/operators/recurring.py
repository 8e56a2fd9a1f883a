"""Recurring charges."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.spend import KEYS, spent
from ledgerloom.plans.shapes import at_rank_with_repeats


@dataclass(frozen=True)
class RecurringLimits:
    """The default thresholds."""

    min_occurrences: int = 3
    amount_cv_max: float = 0.10
    monthly_days: tuple[int, int] = (28, 32)
    weekly_days: tuple[int, int] = (6, 8)
    mad_max_days: int = 3

    def __post_init__(self):
        if self.min_occurrences < 2:
            raise ValueError("an interval needs at least two occurrences")
        if min(self.monthly_days[0], self.weekly_days[0]) < 1:
            raise ValueError("bands start at one day or more")


def charges_of(ledger: DataFrame, until: date | None) -> DataFrame:
    rows = ledger.filter((F.col("amount_cents") < 0) & F.col("merchant_key").isNotNull())
    return rows if until is None else rows.filter(F.col("booking_date") <= F.lit(until))


def charge_gaps(ledger: DataFrame, keys: list[str] = KEYS, until: date | None = None) -> DataFrame:
    """Days since the previous charge of the same merchant, with how many charges show that gap.

    Charges are first counted per day, so the window sees at most one row per merchant and day; the
    other charges of a day have a gap of zero.
    """
    days = charges_of(ledger, until).groupBy(*keys, "merchant_key", "booking_date").agg(
        F.count("*").alias("charges"))
    before = F.lag("booking_date").over(Window.partitionBy(*keys, "merchant_key").orderBy("booking_date"))
    gaps = days.withColumn("gap_days", F.datediff("booking_date", before))
    first_of_day = F.struct(F.col("gap_days"), F.lit(1).cast("long").alias("times"))
    rest_of_day = F.struct(F.lit(0).alias("gap_days"), (F.col("charges") - 1).alias("times"))
    return (
        gaps.select(*keys, "merchant_key", F.inline(F.array(first_of_day, rest_of_day)))
        .filter(F.col("gap_days").isNotNull() & (F.col("times") > 0))
        .groupBy(*keys, "merchant_key", "gap_days").agg(F.sum("times").alias("times"))
    )


def _day_gaps() -> Column:
    """Sorted gaps between the distinct charge dates gathered in `_days`."""
    follow = F.slice("_days", 2, F.greatest(F.size("_days") - 1, F.lit(0)))
    return F.array_sort(F.zip_with(
        follow, F.slice("_days", 1, F.greatest(F.size("_days") - 1, F.lit(0))), lambda b, a: F.datediff(b, a)))


def rhythm(stats: DataFrame, as_of: date, limits: RecurringLimits, keep: list[str]) -> DataFrame:
    """Of merchants with occurrences, _mean, _sd, _last and their sorted distinct _days those that are steady and live."""
    stats = stats.filter((F.col("occurrences") >= limits.min_occurrences) & (F.col("_sd") / F.col("_mean") < limits.amount_cv_max))
    repeats = F.col("occurrences") - F.size("_days")
    rank = F.call_function("div", F.col("occurrences"), F.lit(2)).cast("int")
    gaps = stats.withColumns({"_gaps": _day_gaps(), "_repeats": repeats.cast("int"), "_rank": rank})
    gaps = gaps.withColumn("interval_days", at_rank_with_repeats(
        F.col("_gaps"), F.lit(0), F.col("_repeats"), F.col("_rank")))
    off = F.array_sort(F.transform("_gaps", lambda g: F.abs(g - F.col("interval_days"))))
    gaps = gaps.withColumn("_mad", at_rank_with_repeats(
        off, F.col("interval_days"), F.col("_repeats"), F.col("_rank")))
    steady = F.col("_mad") <= limits.mad_max_days
    period = F.when(F.col("interval_days").between(*limits.monthly_days) & steady, "monthly").when(
        F.col("interval_days").between(*limits.weekly_days) & steady, "weekly")
    live = gaps.withColumns({
        "period": period, "next_expected": F.date_add("_last", F.col("interval_days")),
    }).filter(F.col("period").isNotNull()
              & (F.col("next_expected") >= F.date_sub(F.lit(as_of), F.col("interval_days"))))
    return live.select(*keep, "period", "interval_days", "next_expected", "occurrences")


def detect_recurring(ledger: DataFrame, as_of: date, limits: RecurringLimits = RecurringLimits(),
                     keys: list[str] = KEYS, until: date | None = None,
                     merchants: DataFrame | None = None) -> DataFrame:
    """Merchants charging a steady amount at a monthly or weekly rhythm that have not stopped.

    Pass one reduces each merchant to counts, moments and its set of distinct dates, which cannot
    outgrow the calendar however many charges there are; same-day charges are gaps of zero and only
    their number is needed. Medians come from those small arrays. Pass two fetches the amounts of
    the merchants that are left: a median gap of a day or more means at most about two charges per
    calendar day, so their exact median is over a bounded list too.

    `first_seen` is when the merchant was first seen at all, refunds included: from the table of
    `merchants` (merchant_key, first_seen) where one is passed, else from the ledger's rows of the
    merchants that are left.
    """
    charges = charges_of(ledger, until)
    by = [*keys, "merchant_key"]
    stats = charges.groupBy(*by).agg(
        F.count("*").alias("occurrences"), F.avg(spent()).alias("_mean"), F.stddev_pop(spent()).alias("_sd"),
        F.max("booking_date").alias("_last"),
        F.array_sort(F.collect_set("booking_date")).alias("_days"),
    )
    live = rhythm(stats, as_of, limits, by)
    amounts = (
        charges.select(*by, spent().alias("_spend")).join(live.select(*by), by)
        .groupBy(*by).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _spend)").cast("long")
                          .alias("amount_cents"))
    )
    if merchants is None:
        rows = ledger if until is None else ledger.filter(F.col("booking_date") <= F.lit(until))
        seen = rows.join(live.select(*by), by, "left_semi").groupBy(*by).agg(F.min("booking_date").alias("first_seen"))
        live = live.join(seen, by)
    else:
        live = live.join(merchants.select("merchant_key", "first_seen"), "merchant_key", "left")
    per_year = F.when(F.col("period") == "monthly", 12).otherwise(52)
    return live.join(amounts, by).withColumn("annualized_cents", F.col("amount_cents") * per_year)


def recurring_summary(recurring: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return recurring.groupBy(*keys).agg(
        F.count("*").alias("merchants"), F.coalesce(F.sum("annualized_cents"), F.lit(0)).alias("annualized_cents"))
