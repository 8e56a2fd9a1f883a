"""Monthly reconciliation, its gate and the budget derived from it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT_TAXONOMY, RESIDUAL_GATE_CENTS, Taxonomy
from ledgerloom.functions.dates import month_key, month_start
from ledgerloom.functions.money import whole_div
from ledgerloom.operators.spend import KEYS, sum_if, dated, spent


def reconciliation(ledger: DataFrame, start: date, end: date, keys: list[str] = KEYS,
                   gate_cents: int = RESIDUAL_GATE_CENTS,
                   taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Inflows against fixed and variable spend per calendar month, in one pass over the ledger.

    `refunds_in` and `income_out` close the identity
    residual = uncategorized + transfers_out + net - refunds_in + income_out on every row.
    A month is full when the data of the key covers it from its first to its last day; the first and
    last dates ride along in the monthly aggregate, so finding them needs no second scan.
    """
    cents, category = F.col("amount_cents"), F.col("category")
    out, into = cents < 0, cents > 0
    non_spend, fixed = category.isin(*taxonomy.non_spend), category.isin(*taxonomy.fixed)
    unknown = category == taxonomy.uncategorized
    transfers = [c for b in taxonomy.non_spend_buckets if b != taxonomy.income_bucket
                 for c in taxonomy.in_bucket(b)]
    months = dated(ledger, start, end).groupBy(*keys, month_start(F.col("booking_date")).alias("_first")).agg(
        sum_if(into & non_spend, cents).alias("inflows_cents"),
        sum_if(out & fixed, spent()).alias("fixed_cents"),
        sum_if(out & ~fixed & ~non_spend & ~unknown, spent()).alias("variable_cents"),
        sum_if(out & unknown, spent()).alias("uncategorized_cents"),
        sum_if(out & category.isin(*transfers), spent()).alias("transfers_out_cents"),
        sum_if(into & ~non_spend, cents).alias("refunds_in_cents"),
        sum_if(out & category.isin(*taxonomy.income), spent()).alias("income_out_cents"),
        F.sum(cents).alias("net_cents"),
        F.min("booking_date").alias("_lo"), F.max("booking_date").alias("_hi"),
    )
    whole = Window.partitionBy(*keys)
    residual = F.col("inflows_cents") - F.col("fixed_cents") - F.col("variable_cents")
    return months.withColumns({
        "month": month_key(F.col("_first")),
        "full_month": (F.col("_first") >= F.min("_lo").over(whole))
        & (F.last_day("_first") <= F.max("_hi").over(whole)),
        "residual_cents": residual,
        "gate_pass": F.abs(residual) < gate_cents,
    }).drop("_first", "_lo", "_hi")


def gate_verdict(recon: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """PASS or FAIL over the full months with the worst residual; PENDING when there is none."""
    full = F.col("full_month")
    sums = recon.groupBy(*keys).agg(
        F.count_if(full).alias("full_months"),
        F.bool_and(F.when(full, F.col("gate_pass"))).alias("_pass"),
        F.max(F.when(full, F.abs("residual_cents"))).alias("worst_cents"),
    )
    verdict = F.when(F.col("full_months") == 0, "PENDING").when(F.col("_pass"), "PASS").otherwise("FAIL")
    return sums.withColumn("verdict", verdict).drop("_pass")


def budget_baseline(recon: DataFrame, configured_cents: int | None = None,
                    keys: list[str] = KEYS) -> DataFrame:
    """Monthly budget: the configured one, else the mean spend of the full months, else zero."""
    full = F.col("full_month")
    spend = F.col("fixed_cents") + F.col("variable_cents") + F.col("uncategorized_cents")
    sums = recon.groupBy(*keys).agg(F.count_if(full).alias("_n"), sum_if(full, spend).alias("_sum"))
    if configured_cents:
        budget, source = F.lit(configured_cents).cast("long"), F.lit("configured")
    else:
        some = F.col("_n") > 0
        budget = F.when(some, whole_div(F.col("_sum"), F.greatest("_n", F.lit(1)))).otherwise(0)
        source = F.when(some, "full_month_average").otherwise("no_full_month")
    return sums.select(*keys, budget.alias("budget_cents"), source.alias("budget_source"))
