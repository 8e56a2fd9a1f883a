"""Deterministic row identities."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def booking_text(day: Column, cents: Column, merchant: Column, account: Column) -> Column:
    """The text a booking without a bank reference is identified by."""
    return F.concat_ws(
        "|", day.cast("string"), cents.cast("string"), F.coalesce(merchant, F.lit("")), account
    )


def booking_id(text: Column, occurrence: Column) -> Column:
    """SHA-256 of the booking text; repeats inside one batch carry their number."""
    numbered = F.concat_ws("|", text, occurrence.cast("string"))
    return F.sha2(F.when(occurrence > 0, numbered).otherwise(text), 256)


def fingerprint(source: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, payload), 256)
