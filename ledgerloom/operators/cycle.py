"""Pay cycles and the amount that is safe to spend."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import (
    DEFAULT_TAXONOMY, GREEN_CENTS, INFLOW_EXCLUDE_CENTS, PAYDAY_DAY, RED_CENTS, Taxonomy,
)
from ledgerloom.functions.dates import day_in_month, iso_date, month_bounds, month_start, shift_month
from ledgerloom.functions.money import whole_div
from ledgerloom.operators.spend import KEYS, sum_if, dated, is_held_out, net_bucket, spent
from ledgerloom.plans.shapes import first_per_key


def payday_calendar(accounts: DataFrame, first_month: date, last_month: date,
                    day: int = PAYDAY_DAY, keys: list[str] = KEYS) -> DataFrame:
    """One row per account and month with the scheduled payday."""
    months = F.explode(F.sequence(F.lit(first_month), F.lit(last_month), F.expr("interval 1 month")))
    one_each = accounts.select(*keys).distinct() if keys else accounts.sparkSession.range(1)
    return one_each.select(*keys, months.alias("cycle_month")).withColumns({
        "payday": day_in_month(F.col("cycle_month"), day),
        "payday_source": F.lit("scheduled"),
    })


def cycle_month_of(day: Column, payday_day: int = PAYDAY_DAY) -> Column:
    """First day of the month whose scheduled payday is nearest; a tie goes to the earlier month."""
    month = month_start(day)
    before, after = F.add_months(month, -1), F.add_months(month, 1)
    to_before, to_this, to_after = (
        F.abs(F.datediff(day_in_month(m, payday_day), day)) for m in (before, month, after))
    return (
        F.when(to_before <= F.least(to_this, to_after), before)
        .when(to_this <= to_after, month).otherwise(after)
    )


def log_paydays(reports: DataFrame, as_of: date, payday_day: int = PAYDAY_DAY) -> DataFrame:
    """Owner reports of the day pay arrived, as override rows; unreadable dates are left out.

    `reports` has account_id, text (an ISO date, or blank for today) and ts.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    day = F.when(text == "", F.lit(as_of)).otherwise(iso_date(text))
    return reports.withColumn("actual_date", day).filter(F.col("actual_date").isNotNull()).select(
        "account_id", cycle_month_of(F.col("actual_date"), payday_day).alias("cycle_month"), "actual_date", "ts")


def apply_overrides(calendar: DataFrame, overrides: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Replace a month's payday by the latest logged one."""
    latest = (
        overrides.filter(F.col("actual_date").isNotNull())
        .groupBy(*keys, "cycle_month")
        .agg(F.max_by("actual_date", F.struct("ts", "actual_date")).alias("_actual"))
    )
    return calendar.join(latest, [*keys, "cycle_month"], "left").withColumns({
        "payday": F.coalesce("_actual", "payday"),
        "payday_source": F.when(F.col("_actual").isNotNull(), "logged").otherwise(F.col("payday_source")),
    }).drop("_actual")


def cycles(calendar: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Half-open pay cycles in order of the resolved paydays, which overrides may reorder."""
    ahead = Window.partitionBy(*keys).orderBy("payday")
    distinct = first_per_key(calendar, [*keys, "payday"], [F.desc("cycle_month")])
    return distinct.select(
        *keys, F.col("payday").alias("cycle_start"), F.col("payday_source").alias("cycle_source"),
        F.lead("payday").over(ahead).alias("next_payday"),
    ).filter(F.col("next_payday").isNotNull())


def cycles_around(accounts: DataFrame, as_of: date, day: int = PAYDAY_DAY,
                  overrides: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """The cycle holding `as_of`, one row per account, with the days left in it.

    The calendar reaches two months either way, so an early or late payday cannot leave a gap.
    """
    first = month_bounds(as_of)[0]
    calendar = payday_calendar(accounts, shift_month(first, -2), shift_month(first, 2), day, keys)
    if overrides is not None:
        calendar = apply_overrides(calendar, overrides, keys)
    now = F.lit(as_of)
    return (
        cycles(calendar, keys)
        .filter((F.col("cycle_start") <= now) & (now < F.col("next_payday")))
        .withColumn("days_left", F.datediff("next_payday", now))
    )


def cycle_for(df: DataFrame, day: str, cycle_table: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Attach the cycle each date falls into.

    An interval join made an equi-join: every cycle is listed under the months it touches, rows look
    up their own month, and the range test runs on those few candidates.
    """
    touched = cycle_table.withColumn("_month", F.explode(F.sequence(
        month_start(F.col("cycle_start")), month_start(F.date_sub("next_payday", 1)),
        F.expr("interval 1 month"))))
    rows = df.withColumn("_month", month_start(F.col(day)))
    return rows.join(touched, [*keys, "_month"]).filter(
        (F.col("cycle_start") <= F.col(day)) & (F.col(day) < F.col("next_payday"))).drop("_month")


def spend_per_cycle(ledger: DataFrame, cycle_table: DataFrame, keys: list[str] = KEYS,
                    threshold: int = INFLOW_EXCLUDE_CENTS,
                    taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Net discretionary spend of every pay cycle in the table.

    The ledger is summed per account and day before it meets the cycles, so a busy account brings
    one row per day to the join.
    """
    daily = (
        ledger.filter(net_bucket(threshold, taxonomy).isin(*taxonomy.discretionary))
        .groupBy(*keys, "booking_date").agg(F.sum(spent()).alias("_net"))
    )
    return cycle_for(daily, "booking_date", cycle_table, keys).groupBy(
        *keys, "cycle_start", "next_payday", "cycle_source"
    ).agg(F.sum("_net").alias("net_discretionary_cents"))


def account_status(ledger: DataFrame, as_of: date, pool_cents: int, day: int = PAYDAY_DAY,
                   overrides: DataFrame | None = None, quarantine: DataFrame | None = None,
                   keys: list[str] = KEYS, accounts: DataFrame | None = None,
                   threshold: int = INFLOW_EXCLUDE_CENTS, green: int = GREEN_CENTS, red: int = RED_CENTS,
                   taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Cycle, net spend by bucket, held-out inflows and the safe amount, one row per account.

    Only the days a current cycle can reach are read. They are summed per account and day first;
    the cycle bounds are joined to those sums. Pass a table of `accounts` to include those without
    a row in these days.
    """
    earliest = shift_month(month_bounds(as_of)[0], -2)
    names = {b: f"net_{b.lower()}_cents" for b in taxonomy.buckets}
    recent = dated(ledger, earliest, as_of)
    marked = recent.select(
        *keys, "booking_date", "amount_cents", net_bucket(threshold, taxonomy).alias("_bucket"),
        is_held_out(threshold, taxonomy).alias("_held"))
    daily = marked.groupBy(*keys, "booking_date").agg(
        *[sum_if(F.col("_bucket") == b, spent()).alias(name) for b, name in names.items()],
        F.count_if("_held").alias("inflow_count"),
        sum_if(F.col("_held"), F.col("amount_cents")).alias("inflow_cents"),
    )
    measures = [*names.values(), "inflow_count", "inflow_cents"]
    bounds = cycles_around(accounts if accounts is not None else recent, as_of, day, overrides, keys)
    about = ["cycle_start", "cycle_source", "next_payday", "days_left"]
    if keys:
        counted = F.col("booking_date") >= F.col("cycle_start")
        status = bounds.join(daily, list(keys), "left").groupBy(*keys, *about).agg(
            *[sum_if(counted, F.col(m)).alias(m) for m in measures])
    else:
        one = {name: bounds.select(name).scalar() for name in about}
        status = daily.filter(F.col("booking_date") >= one["cycle_start"]).agg(
            *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]).select(
                *[value.alias(name) for name, value in one.items()], *measures)
    discretionary = sum((F.col(names[b]) for b in taxonomy.discretionary), F.lit(0))
    status = status.withColumns({
        "pool_cents": F.lit(pool_cents).cast("long"), "discretionary_cents": discretionary,
        "remaining_cents": F.lit(pool_cents) - discretionary,
    })
    status = status.withColumn("safe_today_cents", F.greatest(
        F.lit(0), whole_div(F.col("remaining_cents"), F.col("days_left"))).cast("long"))
    status = status.withColumn("light", status_light(F.col("safe_today_cents"), green, red))
    if quarantine is None:
        return status.withColumn("quarantined", F.lit(0).cast("long"))
    if not keys:
        return status.withColumn("quarantined", quarantine.select(F.count("*")).scalar())
    counts = quarantine.groupBy(*keys).agg(F.count("*").alias("quarantined"))
    return status.join(counts, list(keys), "left").withColumn(
        "quarantined", F.coalesce("quarantined", F.lit(0)))


def safe_to_spend(ledger: DataFrame, as_of: date, pool_cents: int, day: int = PAYDAY_DAY,
                  overrides: DataFrame | None = None, keys: list[str] = KEYS,
                  accounts: DataFrame | None = None, threshold: int = INFLOW_EXCLUDE_CENTS,
                  taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """The daily number: what is left of the pool over the days left, never below zero."""
    status = account_status(ledger, as_of, pool_cents, day, overrides, None, keys, accounts,
                            threshold, taxonomy=taxonomy)
    return status.select(*keys, "cycle_start", "cycle_source", "next_payday", "days_left", "pool_cents",
                         "discretionary_cents", "remaining_cents", "safe_today_cents")


def status_light(safe_cents: Column, green: int = GREEN_CENTS, red: int = RED_CENTS) -> Column:
    return F.when(safe_cents > green, "green").when(safe_cents < red, "red").otherwise("amber")


def weekly_plan(status: DataFrame) -> DataFrame:
    """This week's slice of what remains, and the even weekly share of the whole pool."""
    weeks = F.greatest(F.lit(1), F.ceil(F.col("days_left") / 7))
    return status.withColumns({
        "weeks_left": weeks.cast("long"),
        "week_budget_cents": F.greatest(
            F.lit(0), whole_div(F.col("remaining_cents"), weeks)).cast("long"),
        "weekly_rail_cents": whole_div(F.col("pool_cents") * 12, F.lit(52)),
    })
