"""Spend reports. Two measures exist and are never mixed.

Gross: outflows outside the non-spend categories. Net: all signs outside them, so refunds subtract,
with large unlabelled inflows held out. Every report is one filtered scan and one aggregation that
is partly done before the shuffle; the zero rows come from expanding that one aggregated row.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import (
    DEFAULT_TAXONOMY, INFLOW_EXCLUDE_CENTS, SIZE_BANDS, SURPLUS_TARGET_CENTS, Taxonomy,
)
from ledgerloom.functions.dates import month_bounds, month_key, month_start, shift_month
from ledgerloom.operators.categorize import bucket_of
from ledgerloom.plans.shapes import expand, top_per_key, with_accounts

KEYS = ("account_id",)


def dated(df: DataFrame, start: date, end: date) -> DataFrame:
    """Rows booked in the closed range; also prunes month partitions where the table has them."""
    if "booking_month" in df.columns:
        df = df.filter(F.col("booking_month").between(f"{start:%Y-%m}", f"{end:%Y-%m}"))
    return df.filter(F.col("booking_date").between(F.lit(start), F.lit(end)))


def spent() -> Column:
    return -F.col("amount_cents")


def is_gross(taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Column:
    return (F.col("amount_cents") < 0) & ~F.col("category").isin(*taxonomy.non_spend)


def is_held_out(threshold: int, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Column:
    """A large inflow nobody has labelled yet: more likely a transfer than a refund."""
    if threshold <= 0:
        return F.lit(False)
    return (F.col("amount_cents") >= threshold) & (F.col("category") == taxonomy.uncategorized)


def is_net(threshold: int = INFLOW_EXCLUDE_CENTS, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Column:
    return ~F.col("category").isin(*taxonomy.non_spend) & ~is_held_out(threshold, taxonomy)


def net_bucket(threshold: int = INFLOW_EXCLUDE_CENTS, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Column:
    """Bucket of a row that counts towards net spend, else null."""
    return F.when(is_net(threshold, taxonomy), bucket_of(F.col("category"), taxonomy))


def gross_spend(ledger: DataFrame, start: date, end: date,
                taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    return dated(ledger, start, end).filter(is_gross(taxonomy))


def net_scope(ledger: DataFrame, start: date, end: date, threshold: int = INFLOW_EXCLUDE_CENTS,
              taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    return dated(ledger, start, end).filter(is_net(threshold, taxonomy))


def trailing(ledger: DataFrame, as_of: date, days: int) -> DataFrame:
    return dated(ledger, as_of - timedelta(days=days), as_of)


def sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def _share(part: str, whole: Column) -> Column:
    return 100.0 * F.col(part) / F.when(whole == 0, 1).otherwise(whole)


def _gross_rows(ledger: DataFrame, start: date, end: date, keys: list[str], taxonomy: Taxonomy) -> DataFrame:
    """Dated rows with their gross spend, null where there is none: accounts without spend stay in."""
    return dated(ledger, start, end).select(
        *keys, "booking_date", F.when(is_gross(taxonomy), spent()).alias("_spent"))


def category_pareto(ledger: DataFrame, start: date, end: date, keys: list[str] = KEYS,
                    taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Gross spend per category, largest first, with share and running share.

    The windows run over aggregated rows, at most one per category and key.
    """
    by_category = (
        gross_spend(ledger, start, end, taxonomy).groupBy(*keys, "category")
        .agg(F.sum(spent()).alias("spend_cents"), F.count("*").alias("txns"))
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(F.desc("spend_cents"), "category").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("spend_cents").over(whole)
    return by_category.withColumns({
        "rank": F.row_number().over(whole.orderBy(F.desc("spend_cents"), "category")), "pct": _share("spend_cents", total),
        "running": F.sum("spend_cents").over(upto),
    }).withColumn("cum_pct", _share("running", total)).drop("running")


def merchant_pareto(ledger: DataFrame, start: date, end: date, keys: list[str] = KEYS, top: int = 25,
                    taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Largest merchants by gross spend; shares are of all spend, not of the shown rows.

    A merchant's category is the one most of its rows carry. Rows without a merchant are one group.
    """
    by_category = (
        gross_spend(ledger, start, end, taxonomy)
        .groupBy(*keys, F.coalesce("merchant_key", F.lit("(unlinked)")).alias("merchant"), "category")
        .agg(F.sum(spent()).alias("spend"), F.count("*").alias("n"))
    )
    # The total of a key is one more row of the same aggregation, ranked before its merchants.
    sums = by_category.groupingSets([[*keys, "merchant"], [*keys]], *keys, "merchant").agg(
        F.grouping("merchant").alias("_whole"),
        F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"),
        F.sum("spend").alias("spend_cents"), F.sum("n").alias("txns"),
    )
    ranked = top_per_key(sums, list(keys), [F.desc("_whole"), F.desc("spend_cents"), F.col("merchant")], top + 1)
    total = F.max(F.when(F.col("_whole") == 1, F.col("spend_cents"))).over(Window.partitionBy(*keys))
    return (
        ranked.withColumn("_total", total).filter("_whole = 0")
        .withColumns({"rank": F.col("rank") - 1, "pct": _share("spend_cents", F.col("_total"))}).drop("_total", "_whole")
    )


def size_bands(ledger: DataFrame, start: date, end: date, keys: list[str] = KEYS, bands=SIZE_BANDS,
               taxonomy: Taxonomy = DEFAULT_TAXONOMY, accounts: DataFrame | None = None) -> DataFrame:
    """Count and total of gross spend per size band, every band present, for every one of `accounts`."""
    def within(low: int, high: int | None) -> Column:
        inside = F.col("_spent") >= low
        return inside if high is None else inside & (F.col("_spent") < high)

    wide = _gross_rows(ledger, start, end, keys, taxonomy).groupBy(*keys).agg(*[
        agg for i, (_, low, high) in enumerate(bands)
        for agg in (F.count_if(within(low, high)).alias(f"n{i}"),
                    sum_if(within(low, high), F.col("_spent")).alias(f"s{i}"))
    ])
    return expand(with_accounts(wide, accounts, keys), keys, [
        {"band": F.lit(label), "count": F.col(f"n{i}"), "total_cents": F.col(f"s{i}")}
        for i, (label, _, _) in enumerate(bands)
    ])


# Day labels, Monday first.
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def weekday_profile(ledger: DataFrame, start: date, end: date, keys: list[str] = KEYS,
                    taxonomy: Taxonomy = DEFAULT_TAXONOMY, accounts: DataFrame | None = None) -> DataFrame:
    """Gross spend per weekday, every day present, with the weekday and weekend totals alongside."""
    rows = _gross_rows(ledger, start, end, keys, taxonomy).withColumn("_day", F.weekday("booking_date"))
    on = [F.col("_spent").isNotNull() & (F.col("_day") == i) for i in range(7)]
    wide = rows.groupBy(*keys).agg(*[
        agg for i in range(7)
        for agg in (F.count_if(on[i]).alias(f"n{i}"), sum_if(on[i], F.col("_spent")).alias(f"s{i}"))
    ])
    wide = with_accounts(wide, accounts, keys).withColumns({
        "weekday_cents": sum((F.col(f"s{i}") for i in range(1, 5)), F.col("s0")),
        "weekend_cents": F.col("s5") + F.col("s6"),
    })
    return expand(wide, [*keys, "weekday_cents", "weekend_cents"], [
        {"day": F.lit(label), "spend_cents": F.col(f"s{i}"), "txns": F.col(f"n{i}"),
         "weekend": F.lit(i >= 5)}
        for i, label in enumerate(DAYS)
    ])


def daily_spend(ledger: DataFrame, start: date, end: date, keys: list[str] = KEYS,
                taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    return (
        gross_spend(ledger, start, end, taxonomy)
        .groupBy(*keys, "booking_date").agg(F.sum(spent()).alias("spend_cents"))
    )


def burn_rate(ledger: DataFrame, start: date, end: date, budget_cents: int, keys: list[str] = KEYS,
              months: int = 4, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Cumulative spend per day of month, for the latest months, next to an even-spend line.

    Everything after the daily totals works on at most one row per key and day.
    """
    daily = daily_spend(ledger, start, end, keys, taxonomy).withColumn("month", month_start(F.col("booking_date")))
    latest = Window.partitionBy(*keys).orderBy(F.desc("month"))
    span = (
        daily.groupBy(*keys, "month").agg(F.max("booking_date").alias("_last"))
        .withColumn("_place", F.row_number().over(latest)).filter(F.col("_place") <= months)
        .withColumn("_line_days", F.greatest(
            F.lit(30), F.max(F.dayofmonth(F.last_day("month"))).over(Window.partitionBy(*keys))))
        .withColumn("booking_date", F.explode(F.sequence("month", "_last")))
    )
    days = span.join(daily.drop("month"), [*keys, "booking_date"], "left")
    upto = Window.partitionBy(*keys, "month").orderBy("booking_date").rowsBetween(Window.unboundedPreceding, 0)
    day = F.dayofmonth("booking_date")
    return days.select(
        *keys, month_key(F.col("month")).alias("month"), day.alias("day"),
        F.sum(F.coalesce("spend_cents", F.lit(0))).over(upto).alias("cumulative_cents"),
        (budget_cents * (day - 1) / (F.col("_line_days") - 1)).alias("even_spend_cents"),
    )


def spend_total(ledger: DataFrame, start: date, end: date, keys: list[str] = KEYS,
                taxonomy: Taxonomy = DEFAULT_TAXONOMY, accounts: DataFrame | None = None) -> DataFrame:
    """Number and sum of gross outflows; zero for those of `accounts` that have none."""
    sums = gross_spend(ledger, start, end, taxonomy).groupBy(*keys).agg(
        F.count("*").alias("txns"), F.coalesce(F.sum(spent()), F.lit(0)).alias("spend_cents"))
    return with_accounts(sums, accounts, keys)


def _net_rows(ledger: DataFrame, start: date, end: date, keys: list[str], threshold: int,
              taxonomy: Taxonomy) -> DataFrame:
    """Dated rows with their net bucket worked out once, for the conditional sums above it."""
    return dated(ledger, start, end).select(
        *keys, "booking_date", "amount_cents", net_bucket(threshold, taxonomy).alias("_bucket"))


def _bucket_sums(where: Column, taxonomy: Taxonomy, prefix: str = "b") -> list[Column]:
    """One conditional sum per bucket over the rows that satisfy `where`."""
    return [sum_if(where & (F.col("_bucket") == b), spent()).alias(f"{prefix}{i}")
            for i, b in enumerate(taxonomy.buckets)]


def spend_by_bucket(ledger: DataFrame, start: date, end: date, keys: list[str] = KEYS,
                    threshold: int = INFLOW_EXCLUDE_CENTS, taxonomy: Taxonomy = DEFAULT_TAXONOMY,
                    accounts: DataFrame | None = None) -> DataFrame:
    """Net spend per bucket, every bucket present, for every one of `accounts`."""
    rows = _net_rows(ledger, start, end, keys, threshold, taxonomy)
    wide = with_accounts(rows.groupBy(*keys).agg(*_bucket_sums(F.lit(True), taxonomy)), accounts, keys)
    return expand(wide, keys, [
        {"bucket": F.lit(b), "net_cents": F.col(f"b{i}")} for i, b in enumerate(taxonomy.buckets)
    ])


def unlabeled_inflows(ledger: DataFrame, start: date, end: date, keys: list[str] = KEYS,
                      threshold: int = INFLOW_EXCLUDE_CENTS,
                      taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Count and sum of the inflows held out of net spend; zero when the threshold is off."""
    held = is_held_out(threshold, taxonomy)
    return dated(ledger, start, end).groupBy(*keys).agg(
        F.count_if(held).alias("inflow_count"),
        sum_if(held, F.col("amount_cents")).alias("inflow_cents"))


def month_over_month(ledger: DataFrame, as_of: date, keys: list[str] = KEYS,
                     threshold: int = INFLOW_EXCLUDE_CENTS,
                     taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Net spend per bucket of the last full month against the one before; empty buckets dropped."""
    this = month_bounds(as_of)[0]
    current, previous = shift_month(this, -1), shift_month(this, -2)
    in_current = F.col("booking_date") >= F.lit(current)
    both = _net_rows(ledger, previous, this - timedelta(days=1), keys, threshold, taxonomy)
    wide = both.groupBy(*keys).agg(
        *_bucket_sums(in_current, taxonomy, "c"), *_bucket_sums(~in_current, taxonomy, "p"))
    rows = expand(wide, keys, [
        {"bucket": F.lit(b), "prev_cents": F.col(f"p{i}"), "curr_cents": F.col(f"c{i}")}
        for i, b in enumerate(taxonomy.buckets)
    ])
    delta = F.col("curr_cents") - F.col("prev_cents")
    change = F.bround(F.try_divide(delta * 100, F.col("prev_cents")).cast("double"), 0).cast("long")
    return (
        rows.filter((F.col("prev_cents") != 0) | (F.col("curr_cents") != 0))
        .withColumns({
            "prev_month": F.lit(f"{previous:%Y-%m}"), "curr_month": F.lit(f"{current:%Y-%m}"),
            "delta_cents": delta,
            "delta_pct": F.when(F.col("prev_cents") == 0, 100).otherwise(change),
        })
    )


def month_surplus(ledger: DataFrame, keys: list[str] = KEYS, month: date | None = None,
                  threshold: int = INFLOW_EXCLUDE_CENTS, taxonomy: Taxonomy = DEFAULT_TAXONOMY,
                  accounts: DataFrame | None = None) -> DataFrame:
    """Income less net spend, for one month or for all months in one pass.

    For one month the answer is zero where nothing was booked: of the whole ledger without keys, and of every
    one of `accounts`.
    """
    income = (F.col("amount_cents") > 0) & F.col("category").isin(*taxonomy.income)
    measures = [sum_if(income, F.col("amount_cents")).alias("income_cents"),
                sum_if(is_net(threshold, taxonomy), spent()).alias("spend_cents")]
    if month is None:
        sums = ledger.groupBy(*keys, month_key(F.col("booking_date")).alias("month")).agg(*measures)
    else:
        sums = with_accounts(dated(ledger, *month_bounds(month)[:2]).groupBy(*keys).agg(*measures), accounts, keys)
        sums = sums.select(*keys, F.lit(f"{month:%Y-%m}").alias("month"), "income_cents", "spend_cents")
    return sums.withColumn("surplus_cents", F.col("income_cents") - F.col("spend_cents"))


def surplus_vs_target(ledger: DataFrame, as_of: date, keys: list[str] = KEYS,
                      target_cents: int = SURPLUS_TARGET_CENTS, threshold: int = INFLOW_EXCLUDE_CENTS,
                      taxonomy: Taxonomy = DEFAULT_TAXONOMY, accounts: DataFrame | None = None) -> DataFrame:
    """Surplus of the last completed month against the target, for every one of `accounts`."""
    last_month = shift_month(month_bounds(as_of)[0], -1)
    return month_surplus(ledger, keys, last_month, threshold, taxonomy, accounts).withColumns({
        "target_cents": F.lit(target_cents).cast("long"),
        "met": F.col("surplus_cents") >= target_cents,
    })


def bucket_breakdown(ledger: DataFrame, bucket: str, as_of: date, keys: list[str] = KEYS,
                     taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Month-to-date gross spend of the categories inside one bucket."""
    rows = dated(ledger, month_bounds(as_of)[0], as_of).filter(
        (F.col("amount_cents") < 0) & (bucket_of(F.col("category"), taxonomy) == bucket))
    return rows.groupBy(*keys, "category").agg(F.sum(spent()).alias("gross_cents"))


def weekly_digest(ledger: DataFrame, as_of: date, keys: list[str] = KEYS,
                  threshold: int = INFLOW_EXCLUDE_CENTS,
                  taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Net spend per bucket of the last 7 days against the 7 before.

    The week totals count only buckets above zero.
    """
    week = as_of - timedelta(days=6)
    now = F.col("booking_date") >= F.lit(week)
    both = _net_rows(ledger, week - timedelta(days=7), as_of, keys, threshold, taxonomy)
    wide = both.groupBy(*keys).agg(*_bucket_sums(now, taxonomy, "w"), *_bucket_sums(~now, taxonomy, "p"))

    def positive(prefix: str) -> Column:
        return sum((F.greatest(F.col(f"{prefix}{i}"), F.lit(0)) for i in range(len(taxonomy.buckets))), F.lit(0))

    wide = wide.withColumns({"week_total_cents": positive("w"), "prev_total_cents": positive("p")})
    return expand(wide, [*keys, "week_total_cents", "prev_total_cents"], [
        {"bucket": F.lit(b), "week_cents": F.col(f"w{i}"), "prev_cents": F.col(f"p{i}"),
         "delta_cents": F.col(f"w{i}") - F.col(f"p{i}")}
        for i, b in enumerate(taxonomy.buckets)
    ])


def top_movers(digest: DataFrame, keys: list[str] = KEYS, n: int = 3) -> DataFrame:
    """The buckets that moved most, unchanged ones left out."""
    moved = digest.filter(F.col("delta_cents") != 0).select(*keys, "bucket", "delta_cents")
    return top_per_key(moved, list(keys), [F.desc(F.abs("delta_cents")), F.col("bucket")], n)


def top_spends(ledger: DataFrame, as_of: date, keys: list[str] = KEYS, n: int = 3,
               taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Largest outflows of the last 7 days."""
    rows = gross_spend(ledger, as_of - timedelta(days=6), as_of, taxonomy).select(
        *keys, "id", "booking_date", "merchant_raw", "category", spent().alias("spend_cents"))
    return top_per_key(rows, list(keys), [F.desc("spend_cents"), F.col("booking_date"), F.col("id")], n)


def latest_in_category(ledger: DataFrame, category: str, as_of: date, keys: list[str] = KEYS,
                       n: int = 10) -> DataFrame:
    """Newest outflows of one category this month, with the whole month's total alongside."""
    rows = dated(ledger, month_bounds(as_of)[0], as_of).filter(
        (F.col("amount_cents") < 0) & (F.col("category") == category)
    ).select(*keys, "id", "booking_date", "merchant_raw", spent().alias("spend_cents"))
    newest = top_per_key(rows, list(keys), [F.desc("booking_date"), F.col("id")], n)
    if not keys:
        return newest.withColumn("month_total_cents", rows.select(F.sum("spend_cents")).scalar())
    totals = rows.groupBy(*keys).agg(F.sum("spend_cents").alias("month_total_cents"))
    return newest.join(totals, list(keys))
