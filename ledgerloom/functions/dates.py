"""Date helpers as column expressions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day-first forms rewritten to ISO. Fixed value: two-digit years from 69 on belong to the 1900s.
_TO_ISO = (
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$2-$1"),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-5][0-9]|6[0-8])$", "20$3-$2-$1"),
    (r"^([0-9]{1,2})/([0-9]{1,2})/(69|[7-9][0-9])$", "19$3-$2-$1"),
)
_ISO = r"^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"


def parse_date(text: Column) -> Column:
    """`d/m/yy`, `d/m/yyyy` or ISO text to a date; null when it is none of them."""
    iso = F.trim(text)
    for pattern, form in _TO_ISO:
        iso = F.regexp_replace(iso, pattern, form)
    return F.regexp_extract(iso, _ISO, 0).try_cast("date")


def iso_date(text: Column) -> Column:
    """Strict `yyyy-mm-dd` text to a date, else null."""
    return F.regexp_extract(text, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", 0).try_cast("date")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def day_in_month(first: Column, day: Column | int) -> Column:
    """The given day of the month starting at `first`, pulled back to the month's end."""
    day = day if isinstance(day, Column) else F.lit(day)
    return F.least(F.date_add(first, day - 1), F.last_day(first))


def iso_week_key(day: Column) -> Column:
    """`2026-W07`, by ISO year and week."""
    week = F.extract(F.lit("WEEK"), day).cast("string")
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(week, 2, "0"))


# The same calendar arithmetic for arguments that are already known when a job is built.

def month_bounds(as_of: date) -> tuple[date, date, int]:
    """First day, last day and length of the month holding `as_of`."""
    first = as_of.replace(day=1)
    last = shift_month(first, 1) - timedelta(days=1)
    return first, last, last.day


def shift_month(first: date, by: int) -> date:
    index = first.year * 12 + first.month - 1 + by
    return date(index // 12, index % 12 + 1, 1)


def trailing(as_of: date, days: int) -> tuple[date, date]:
    """The closed window ending at `as_of`; both ends count, so it spans days + 1 days."""
    return as_of - timedelta(days=days), as_of


def clamp_day(first: date, day: int) -> date:
    return first.replace(day=min(day, month_bounds(first)[2]))
