"""Monthly spending caps: matching, running totals, breaches and their text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT_TAXONOMY, INFLOW_EXCLUDE_CENTS, Policy, Taxonomy
from ledgerloom.functions.dates import month_bounds, month_key, month_start
from ledgerloom.functions.money import format_eur, ordinal
from ledgerloom.functions.names import display_name
from ledgerloom.operators.categorize import bucket_of, with_bucket
from ledgerloom.operators.patterns import with_numbers
from ledgerloom.operators.spend import KEYS, dated, is_held_out, spent
from ledgerloom.plans.shapes import BLOCK_ROWS, HOT_ROWS, block_of, not_stored, running_totals, same


def policy_condition(policy: Policy, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Column:
    """Patterns look at the merchant key, the same surface the category rules see."""
    if policy.bucket is not None:
        return bucket_of(F.col("category"), taxonomy) == policy.bucket
    if policy.sub_label is not None:
        return F.col("category") == policy.sub_label
    return F.coalesce(F.col("merchant_key").rlike(policy.pattern), F.lit(False))


def match_own_policies(ledger: DataFrame, policies: DataFrame, keys: list[str] = KEYS,
                       taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """The same as `match_policies` for a table with each account's own policies.

    `policies` has the keys, ord, policy, cap_cents and one of bucket, sub_label and pattern. They are matched with what an
    account's rows are about, its distinct categories and merchants, by equal bucket, label or index entry; the
    ledger then meets one row for each of those, which lists its policies in order. The planner takes rows that were listed in a
    row of the accounts for few, so these joins are sort-merge: a broadcast of them would have to fit into the driver.
    """
    about = [*keys, "category", "merchant_key"]
    kinds = with_bucket(ledger.select(*about).distinct(), taxonomy)
    hit = F.struct("ord", "policy", F.col("cap_cents").cast("long").alias("cap_cents")).alias("_hit")

    def equal(what: str, to: str) -> DataFrame:
        asked = policies.filter(F.col(what).isNotNull()).select(*keys, F.col(what).alias(to), hit)
        return kinds.join(asked.hint("merge"), [*keys, to]).select(*about, "_hit")

    by_name = with_numbers(kinds, policies.select(*keys, hit.alias("number"), "pattern"), keys).select(
        *about, F.explode("numbers").alias("_hit"))
    hits = equal("bucket", "bucket").unionByName(equal("sub_label", "category")).unionByName(by_name) \
        .groupBy(*about).agg(F.array_sort(F.collect_list("_hit")).alias("_hits")) \
        .select("_hits", *[F.col(c).alias(f"{c}__of") for c in about]).hint("merge")
    rows = ledger.join(hits, same(ledger, hits, {c: f"{c}__of" for c in about}))
    return rows.select(*ledger.columns, F.inline("_hits"), F.col("_hits")[0]["ord"].alias("_first")) \
        .withColumn("is_first", F.col("ord") == F.col("_first")).drop("_first")


def match_policies(ledger: DataFrame, policies: list[Policy] | DataFrame,
                   taxonomy: Taxonomy = DEFAULT_TAXONOMY, keys: list[str] = KEYS) -> DataFrame:
    """One row per ledger row and policy it matches, marking which policy comes first for the row.

    The first match is known before the rows fan out, so picking it later needs no window per row. `policies` is
    one list for all accounts or a table with each account's own.
    """
    if isinstance(policies, DataFrame):
        return match_own_policies(ledger, policies, keys, taxonomy)
    hits = F.array(*[
        F.when(policy_condition(p, taxonomy), F.struct(
            F.lit(i).alias("ord"), F.lit(p.name).alias("policy"),
            F.lit(p.cap_monthly_cents).cast("long").alias("cap_cents")))
        for i, p in enumerate(policies)
    ])
    rows = ledger.withColumn("_hits", F.filter(hits, lambda hit: hit.isNotNull()))
    return rows.withColumn("_first", F.get("_hits", F.lit(0))["ord"]).select(
        *ledger.columns, F.inline("_hits"), "_first"
    ).withColumn("is_first", F.col("ord") == F.col("_first")).drop("_first")


def matched_months(ledger: DataFrame, policies: list[Policy] | DataFrame, keys: list[str] = KEYS,
                   threshold: int = INFLOW_EXCLUDE_CENTS, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Rows that count towards caps, one for each cap they match, with the first of their month."""
    kept = ledger.filter(~is_held_out(threshold, taxonomy)).select(
        "id", *keys, "booking_date", "batch_id", "batch_ord", "amount_cents", "merchant_raw",
        "merchant_key", "category")
    return match_policies(kept, policies, taxonomy, keys).withColumn("month", month_start(F.col("booking_date")))


def policy_progress(ledger: DataFrame, policies: list[Policy] | DataFrame, keys: list[str] = KEYS,
                    threshold: int = INFLOW_EXCLUDE_CENTS, block_rows: int = BLOCK_ROWS,
                    hot_rows: int | None = HOT_ROWS, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Month-to-date net spend and charge number of every matching row, the row included.

    Order is booking date, then insertion. The month of a very busy account is cut by day, batch and
    block of rows, so no task holds all of it.
    """
    matched = matched_months(ledger, policies, keys, threshold, taxonomy).withColumn(
        "block", block_of(F.col("batch_ord"), block_rows))
    return running_totals(
        matched, by=[*keys, "ord", "month"], block=["booking_date", "batch_id", "block"],
        order=["batch_ord", "id"],
        totals={"mtd_cents": spent(), "charge_number": F.when(F.col("amount_cents") < 0, 1).otherwise(0)},
        hot_rows=hot_rows,
    ).drop("block")


def policy_alerts(ledger: DataFrame, policies: list[Policy] | DataFrame, as_of: date | None = None,
                  new_ids: DataFrame | None = None, keys: list[str] = KEYS,
                  threshold: int = INFLOW_EXCLUDE_CENTS, block_rows: int = BLOCK_ROWS,
                  hot_rows: int | None = HOT_ROWS, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """New outflows whose first matching policy is over its cap at that point of the month.

    The first match alone decides; a later policy never fires for the row, though its running total
    counts it. With `as_of` only that calendar month is looked at, to its end; without it every row
    is judged in its own month.
    """
    if as_of is not None:
        ledger = dated(ledger, *month_bounds(as_of)[:2])
    over = policy_progress(ledger, policies, keys, threshold, block_rows, hot_rows, taxonomy).filter(
        F.col("is_first") & (F.col("amount_cents") < 0) & (F.col("mtd_cents") > F.col("cap_cents")))
    if new_ids is not None:
        over = over.join(new_ids.select("id"), "id", "left_semi")
    return over.select(
        "id", *keys, "booking_date", month_key(F.col("month")).alias("month"), "policy", "cap_cents",
        "amount_cents", "mtd_cents", "charge_number", alert_text().alias("text"))


def alert_text() -> Column:
    shown = display_name(F.col("merchant_raw"))
    return F.concat(
        F.when(shown != "", shown).otherwise(F.col("policy")), F.lit(": "), format_eur(spent()),
        F.lit(", "), ordinal(F.col("charge_number")), F.lit(" charge this month. "),
        F.col("policy"), F.lit(" stands at "), format_eur(F.col("mtd_cents")),
        F.lit(" against a cap of "), format_eur(F.col("cap_cents")),
        F.lit("; that is "), format_eur(F.col("mtd_cents") * 12), F.lit(" a year."))


def new_since(ledger: DataFrame, mark: str | None) -> DataFrame:
    """Rows of batches loaded after `mark`. With no mark there is no baseline yet and nothing is new."""
    return ledger.filter(F.lit(False) if mark is None else F.col("batch_id") > mark)


def unsent(alerts: DataFrame, alert_log: DataFrame, on: list[str] = ("kind", "subject_id")) -> DataFrame:
    """Alerts not in the log yet."""
    return not_stored(alerts, alert_log, list(on))
