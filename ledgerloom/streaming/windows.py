"""Transformations that read the same on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT_TAXONOMY, Taxonomy
from ledgerloom.functions.dates import iso_week_key
from ledgerloom.operators.spend import KEYS, is_gross, spent
from ledgerloom.plans.shapes import first_per_key


def dedupe_stream(df: DataFrame, delay: str = "5 days", ts: str = "booking_ts", key: str = "id") -> DataFrame:
    """Drop repeats of an id that arrive within the delay; the state kept is bounded by it.

    On a table the first copy in the order of time and then of all other columns stays. Ingest itself
    dedupes exactly against the stored ids.
    """
    if df.isStreaming:
        return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    others = [c for c in df.columns if c not in (ts, key)]
    return first_per_key(df, [key], [c for c in (ts, *others) if c in df.columns])


def _windowed(df: DataFrame, window, ts: str, keys: list[str], delay: str, taxonomy: Taxonomy) -> DataFrame:
    rows = df.withWatermark(ts, delay) if df.isStreaming else df
    return (
        rows.filter(is_gross(taxonomy)).groupBy(*keys, window.alias("_w"))
        .agg(F.sum(spent()).alias("spend_cents"), F.count("*").alias("txns"))
    )


def daily_spend_stream(df: DataFrame, ts: str = "booking_ts", keys: list[str] = KEYS, delay: str = "5 days",
                       taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Gross spend per calendar day."""
    days = _windowed(df, F.window(ts, "1 day"), ts, keys, delay, taxonomy)
    return days.select(*keys, F.to_date("_w.start").alias("day"), "spend_cents", "txns")


def weekly_spend_stream(df: DataFrame, ts: str = "booking_ts", keys: list[str] = KEYS, delay: str = "5 days",
                        taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Gross spend of the seven days ending with each day.

    On a table the rows are summed per day first, so only daily sums are spread over the seven days
    they count for.
    """
    if not df.isStreaming:
        days = daily_spend_stream(df, ts, keys, delay, taxonomy)
        ends = F.explode(F.sequence("day", F.date_add("day", 6), F.expr("interval 1 day")))
        return days.withColumn("day", ends).groupBy(*keys, "day").agg(
            F.sum("spend_cents").alias("spend_cents"), F.sum("txns").alias("txns"))
    weeks = _windowed(df, F.window(ts, "7 days", "1 day"), ts, keys, delay, taxonomy)
    return weeks.select(*keys, F.date_sub(F.to_date("_w.end"), 1).alias("day"), "spend_cents", "txns")


def period_key(day, period: str):
    """Name of the day or ISO week a date belongs to."""
    if period == "day":
        return day.cast("string")
    if period == "week":
        return iso_week_key(day)
    raise ValueError(f"period must be day or week, not {period!r}")


def once_per(df: DataFrame, kind: str, period: str, emission_log: DataFrame, day: str = "as_of",
             keys: list[str] = KEYS) -> DataFrame:
    """Rows whose kind has not been emitted yet for their key and period."""
    named = df.withColumns({"kind": F.lit(kind), "period_key": period_key(F.col(day), period)})
    on = [*keys, "kind", "period_key"]
    return named.join(emission_log.select(*on).distinct(), on, "left_anti")
