"""Running totals of caps as a kept state: a batch costs what it holds, not what its months hold.

The state is a log of sums, one for each account, cap, day and load, written under the stream batch that brought
them; a batch that runs again replaces its own sums. The total at a new row is the sum of all earlier places
of its month plus the new rows before it, so a late row finds the total at its own place, and only what
comes after it in its month is counted higher from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT_TAXONOMY, INFLOW_EXCLUDE_CENTS, Policy, Taxonomy
from ledgerloom.functions.dates import month_key
from ledgerloom.operators.policy import alert_text, match_policies, matched_months
from ledgerloom.operators.spend import KEYS
from ledgerloom.plans.shapes import BLOCK_ROWS, HOT_ROWS, block_of, running_totals

TOTALS = ("cents", "charges")


def _sums(matched: DataFrame) -> DataFrame:
    return matched.withColumns({
        "cents": -F.col("amount_cents"), "charges": F.when(F.col("amount_cents") < 0, 1).otherwise(0).cast("long")})


def progress_sums(rows: DataFrame, policies: list[Policy] | DataFrame, keys: list[str] = KEYS,
                  threshold: int = INFLOW_EXCLUDE_CENTS, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """What categorized rows add to the state: keys, ord, month, booking_date, batch_id and the sums, taken map-side."""
    matched = _sums(matched_months(rows, policies, keys, threshold, taxonomy))
    return matched.groupBy(*keys, "ord", "month", "booking_date", "batch_id").agg(
        *[F.sum(name).alias(name) for name in TOTALS])


def merged_sums(*states: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One state from several. The order does not matter, nor how rows were dealt to them."""
    first, *rest = states
    for other in rest:
        first = first.unionByName(other)
    return first.groupBy(*keys, "ord", "month", "booking_date", "batch_id").agg(
        *[F.sum(name).alias(name) for name in TOTALS])


def progress_from_state(fresh: DataFrame, state: DataFrame, policies: list[Policy] | DataFrame, keys: list[str] = KEYS,
                        threshold: int = INFLOW_EXCLUDE_CENTS, block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS,
                        taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """`policy.policy_progress` of the new rows, from the sums of all rows stored before them.

    Rows are in order of booking date, load, and place in the load. Of the state only the months and caps that new rows
    touch are taken, by a semi-join that Spark broadcasts when it is small.
    """
    matched = _sums(matched_months(fresh, policies, keys, threshold, taxonomy)).withColumn("block", block_of(F.col("batch_ord"), block_rows))
    place = [*keys, "ord", "month"]
    asked = matched.select(*[F.col(c).alias(f"{c}__of") for c in place]).distinct()
    touched = state.join(asked, [state[c].eqNullSafe(asked[f"{c}__of"]) for c in place], "left_semi")
    lines = matched.withColumn("is_new", F.lit(True)).unionByName(
        touched.select(*place, "booking_date", "batch_id", *TOTALS).withColumns({"is_new": F.lit(False), "block": F.lit(-1).cast("long")}),
        allowMissingColumns=True)
    return running_totals(
        lines, by=place, block=["booking_date", "batch_id", "block"], order=["is_new", "batch_ord", "id"],
        totals={"mtd_cents": F.col("cents"), "charge_number": F.col("charges")}, hot_rows=hot_rows,
    ).filter("is_new").drop("is_new", "block", *TOTALS)


def alerts_from_state(fresh: DataFrame, state: DataFrame, policies: list[Policy] | DataFrame, keys: list[str] = KEYS,
                      threshold: int = INFLOW_EXCLUDE_CENTS, block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS,
                      taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """`policy.policy_alerts` of the new rows, each judged in its own month, without reading the ledger."""
    over = progress_from_state(fresh, state, policies, keys, threshold, block_rows, hot_rows, taxonomy).filter(
        F.col("is_first") & (F.col("amount_cents") < 0) & (F.col("mtd_cents") > F.col("cap_cents")))
    return over.select(
        "id", *keys, "booking_date", month_key(F.col("month")).alias("month"), "policy", "cap_cents",
        "amount_cents", "mtd_cents", "charge_number", alert_text().alias("text"))
