"""Expected bills: what is due, what was paid, what is late or has changed."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import EARLY_MATCH_DAYS, GRACE_DAYS, Bill
from ledgerloom.functions.dates import clamp_day, day_in_month, month_bounds, month_start, shift_month
from ledgerloom.functions.money import format_eur
from ledgerloom.operators.patterns import matches
from ledgerloom.operators.spend import KEYS, dated


def due_on_or_before(as_of: date, due_day: int) -> date:
    """Latest due date at or before `as_of`; a missing day of the month means its last day."""
    first = month_bounds(as_of)[0]
    this = clamp_day(first, due_day)
    return this if this <= as_of else clamp_day(shift_month(first, -1), due_day)


def current_due(as_of: Column, due_day: Column) -> Column:
    """The same as a column expression, for due days or dates held in tables."""
    first = month_start(as_of)
    this = day_in_month(first, due_day)
    return F.when(this <= as_of, this).otherwise(day_in_month(F.add_months(first, -1), due_day))


def _bill_structs(bills: list[Bill], as_of: date) -> Column:
    return F.array(*[
        F.struct(
            F.lit(b.name).alias("bill"), F.lit(due_on_or_before(as_of, b.due_day)).alias("due"),
            F.lit(b.expected_cents).cast("long").alias("expected_cents"),
            F.lit(b.expected_cents * (100 - b.tolerance_pct) // 100).cast("long").alias("low_cents"),
            F.lit(b.expected_cents * (100 + b.tolerance_pct) // 100).cast("long").alias("high_cents"))
        for b in bills
    ])


def match_bills(ledger: DataFrame, bills: list[Bill], as_of: date, early_days: int = EARLY_MATCH_DAYS,
                keys: list[str] = KEYS) -> DataFrame:
    """Latest outflow paying each bill, from a few days before its due date up to `as_of`.

    Bills are literals in the plan: each row is tested against them in the scan, and the latest
    match is a maximum that is taken map-side before the shuffle.
    """
    starts = {b.name: due_on_or_before(as_of, b.due_day) - timedelta(days=early_days) for b in bills}
    paid = F.array(*[
        F.when((F.col("booking_date") >= F.lit(starts[b.name])) & F.col("merchant_key").rlike(b.pattern),
               F.lit(b.name))
        for b in bills
    ])
    rows = dated(ledger, min(starts.values(), default=as_of), as_of).filter(F.col("amount_cents") < 0)
    return (
        rows.select(*keys, "booking_date", "batch_id", "batch_ord", "id", "amount_cents",
                    F.explode(F.array_compact(paid)).alias("bill"))
        .groupBy(*keys, "bill")
        .agg(F.max(F.struct("booking_date", "batch_id", "batch_ord", "id", "amount_cents")).alias("_last"))
        .select(*keys, "bill", F.col("_last.booking_date").alias("paid_on"),
                (-F.col("_last.amount_cents")).alias("paid_cents"))
    )


def bill_state(ledger: DataFrame, bills: list[Bill], as_of: date, grace_days: int = GRACE_DAYS,
               early_days: int = EARLY_MATCH_DAYS, keys: list[str] = KEYS,
               accounts: DataFrame | None = None) -> DataFrame:
    """Every account and bill with its due date and, where found, its payment.

    Accounts default to those in the ledger; pass a table of accounts to include silent ones.
    """
    known = accounts if accounts is not None else ledger
    one_each = known.select(*keys).distinct() if keys else known.sparkSession.range(1)
    expected = one_each.select(*keys, F.inline(_bill_structs(bills, as_of)))
    state = expected.join(match_bills(ledger, bills, as_of, early_days, keys), [*keys, "bill"], "left")
    return state.withColumns({
        "days_past_due": F.datediff(F.lit(as_of), "due"),
        "overdue": F.col("paid_on").isNull() & (F.datediff(F.lit(as_of), "due") > grace_days),
    })


def bill_windows(bills: DataFrame, as_of: date | None = None, early_days: int = EARLY_MATCH_DAYS) -> DataFrame:
    """A table of bills with the window in which each is looked for: due and start dates, and the tolerated amounts.

    Every bill has its own `as_of` day, or all have the one given.
    """
    day = F.col("as_of") if as_of is None else F.lit(as_of)
    expected, tolerance = F.col("expected_cents"), F.col("tolerance_pct")
    return bills.withColumns({"as_of": day, "due": current_due(day, F.col("due_day"))}).withColumns({
        "start": F.date_sub("due", early_days),
        "low_cents": F.call_function("div", expected * (100 - tolerance), F.lit(100)),
        "high_cents": F.call_function("div", expected * (100 + tolerance), F.lit(100))})


def match_own_bills(ledger: DataFrame, windows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Latest outflow paying each bill of a table of windows (keys, bill, pattern, as_of, start).

    The ledger is first cut to the days that any window covers and reduced, map-side, to the last outflow of a merchant
    and day. Patterns are matched with an account's distinct merchants. A window is listed under every month it
    touches, so days meet it by an equal month and are then held against its borders. Joins are sort-merge: the planner takes
    bills that were listed in a row for few, and a broadcast of them would have to fit into the driver.
    """
    span = windows.agg(F.min("start").alias("first"), F.max("as_of").alias("last"))
    day = F.col("booking_date")
    rows = ledger.filter((F.col("amount_cents") < 0) & (day >= span.select("first").scalar()) & (day <= span.select("last").scalar()))
    latest = rows.groupBy(*keys, "merchant_key", "booking_date").agg(
        F.max(F.struct("batch_id", "batch_ord", "id", "amount_cents")).alias("_last"))
    asked = windows.select(*keys, F.col("bill").alias("number"), "pattern").distinct()
    payers = matches(latest, asked, keys).withColumnRenamed("number", "bill")
    months = F.sequence(month_start(F.col("start")), month_start(F.col("as_of")), F.make_ym_interval(F.lit(0), F.lit(1)))
    binned = windows.select(*keys, "bill", "as_of", "start", F.explode(months).alias("_month"))
    return (
        latest.withColumn("_month", month_start(day)).join(payers.hint("merge"), [*keys, "merchant_key"])
        .join(binned.hint("merge"), [*keys, "bill", "_month"]).filter(day.between(F.col("start"), F.col("as_of")))
        .groupBy(*keys, "bill", "as_of").agg(F.max(F.struct("booking_date", "_last")).alias("_paid"))
        .select(*keys, "bill", "as_of", F.col("_paid.booking_date").alias("paid_on"),
                (-F.col("_paid._last.amount_cents")).alias("paid_cents"))
    )


def own_bill_state(ledger: DataFrame, bills: DataFrame, as_of: date | None = None, grace_days: int = GRACE_DAYS,
                   early_days: int = EARLY_MATCH_DAYS, keys: list[str] = KEYS) -> DataFrame:
    """Every bill of a table with each account's own, with its due date and, where found, its payment.

    `bills` has the keys, bill (a name that the account uses once), pattern, due_day, expected_cents, tolerance_pct and,
    unless all are looked at on the day given, as_of: one bill may so be looked at on many days.
    """
    windows = bill_windows(bills, as_of, early_days)
    state = windows.select(*keys, "bill", "as_of", "due", "expected_cents", "low_cents", "high_cents").join(
        match_own_bills(ledger, windows, keys).hint("merge"), [*keys, "bill", "as_of"], "left")
    late = F.datediff("as_of", "due")
    return state.withColumns({"days_past_due": late, "overdue": F.col("paid_on").isNull() & (late > grace_days)})


def bill_alerts(state: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Unpaid bills past their grace, and payments outside the tolerated amount."""
    drift = F.col("paid_on").isNotNull() & ~F.col("paid_cents").between(F.col("low_cents"), F.col("high_cents"))
    kind = F.when(drift, "drift").when(F.col("overdue"), "late")
    text = F.when(drift, F.concat(
        F.col("bill"), F.lit(" came to "), format_eur(F.col("paid_cents")), F.lit(" instead of about "),
        format_eur(F.col("expected_cents")))).otherwise(F.concat(
            F.col("bill"), F.lit(" has not been paid, "), F.col("days_past_due").cast("string"),
            F.lit(" days after "), F.col("due").cast("string")))
    return state.withColumns({"kind": kind, "text": text}).filter(F.col("kind").isNotNull()).select(
        *keys, "bill", "kind", "due", "paid_on", "paid_cents", "expected_cents", "days_past_due", "text",
        F.concat_ws("|", "bill", F.col("due").cast("string"), "kind").alias("period_key"))


def bill_checklist(state: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    status = F.when(F.col("paid_on").isNotNull(), "paid").when(F.col("overdue"), "overdue").otherwise("pending")
    return state.select(*keys, "bill", "due", status.alias("status"), "paid_on", "paid_cents")
