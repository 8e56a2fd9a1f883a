"""The scheduled jobs: monthly report, daily number and weekly digest, for all accounts at once.

Each returns lazy tables. A dry run is not writing them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import (
    DEFAULT_TAXONOMY, GRACE_DAYS, INFLOW_EXCLUDE_CENTS, PAYDAY_DAY, REPORT_WINDOW_DAYS, Bill, Rule, Taxonomy,
)
from ledgerloom.functions.dates import trailing
from ledgerloom.operators import bills as bill_ops
from ledgerloom.operators import cycle, recon, recurring, spend
from ledgerloom.operators.categorize import categorize, categorized
from ledgerloom.sources.tables import keep, write_table


def prepared_ledger(ledger: DataFrame, labels: DataFrame | None, overrides: DataFrame | None,
                    rules: list[Rule], name: str, fallback: str,
                    taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """The categorized ledger as a written table, so a dozen reports do not repeat its joins.

    The merchant table is written first: its file size tells Spark whether it may be broadcast.
    """
    dims = ledger.filter(F.col("merchant_key").isNotNull()).groupBy("merchant_key").agg(
        F.min("booking_date").alias("first_seen"))
    merchants = keep(categorize(dims, labels, rules, taxonomy), f"{name}-merchants", fallback)
    return keep(categorized(ledger, merchants, overrides, taxonomy), f"{name}-ledger", fallback)


def monthly_report(ledger: DataFrame, as_of: date, keys: list[str] = spend.KEYS,
                   window_days: int = REPORT_WINDOW_DAYS, budget_cents: int | None = None,
                   limits: recurring.RecurringLimits = recurring.RecurringLimits(),
                   threshold: int = INFLOW_EXCLUDE_CENTS, taxonomy: Taxonomy = DEFAULT_TAXONOMY,
                   accounts: DataFrame | None = None, work: str | None = None) -> dict[str, DataFrame]:
    """All tables of the monthly report over a categorized ledger, with zeros for silent `accounts`.

    With a folder `work`, the two tables that others build on are written there once and not computed again.
    """
    start, end = trailing(as_of, window_days)
    months = recon.reconciliation(ledger, start, end, keys, taxonomy=taxonomy)
    found = recurring.detect_recurring(ledger, as_of, limits, keys)
    if work is not None:
        months, found = keep(months, "reconciliation", work), keep(found, "recurring", work)
    return {
        "spend_total": spend.spend_total(ledger, start, end, keys, taxonomy, accounts),
        "category_pareto": spend.category_pareto(ledger, start, end, keys, taxonomy),
        "merchant_pareto": spend.merchant_pareto(ledger, start, end, keys, taxonomy=taxonomy),
        "size_bands": spend.size_bands(ledger, start, end, keys, taxonomy=taxonomy, accounts=accounts),
        "weekday_profile": spend.weekday_profile(ledger, start, end, keys, taxonomy, accounts),
        "daily_spend": spend.daily_spend(ledger, start, end, keys, taxonomy),
        "burn_rate": spend.burn_rate(ledger, start, end, budget_cents or 0, keys, taxonomy=taxonomy),
        "reconciliation": months,
        "gate_verdict": recon.gate_verdict(months, keys),
        "budget": recon.budget_baseline(months, budget_cents, keys),
        "month_over_month": spend.month_over_month(ledger, as_of, keys, threshold, taxonomy),
        "recurring": found,
        "recurring_summary": recurring.recurring_summary(found, keys),
    }


def weekly_digest(ledger: DataFrame, as_of: date, pool_cents: int, bills: list[Bill] = (),
                  grace_days: int = GRACE_DAYS, payday_day: int = PAYDAY_DAY,
                  overrides: DataFrame | None = None, keys: list[str] = spend.KEYS,
                  threshold: int = INFLOW_EXCLUDE_CENTS, taxonomy: Taxonomy = DEFAULT_TAXONOMY,
                  accounts: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the weekly digest; `accounts` brings in those without recent rows."""
    buckets = spend.weekly_digest(ledger, as_of, keys, threshold, taxonomy)
    status = cycle.account_status(ledger, as_of, pool_cents, payday_day, overrides, keys=keys,
                                  accounts=accounts, threshold=threshold, taxonomy=taxonomy)
    tables = {
        "digest": buckets,
        "top_movers": spend.top_movers(buckets, keys),
        "top_spends": spend.top_spends(ledger, as_of, keys, taxonomy=taxonomy),
        "status": status,
        "weekly_plan": cycle.weekly_plan(status),
        "surplus": spend.surplus_vs_target(ledger, as_of, keys, threshold=threshold, taxonomy=taxonomy,
                                                 accounts=accounts),
    }
    if bills:
        tables["bill_checklist"] = bill_ops.bill_checklist(
            bill_ops.bill_state(ledger, bills, as_of, grace_days, keys=keys, accounts=accounts), keys)
    return tables


def write_report(tables: dict[str, DataFrame], folder: str, as_of: date) -> None:
    """Write each table under its name and report date; writing the same date again replaces it."""
    for name, table in tables.items():
        write_table(table, f"{folder}/{name}/as_of={as_of.isoformat()}")
