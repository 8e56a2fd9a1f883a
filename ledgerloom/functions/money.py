"""Money as whole cents: exact parsing and display, all as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_AMOUNT = r"^[+-]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]{1,2})?$"


def parse_cents(text: Column) -> Column:
    """Decimal text to cents, or null when the text is not an exact amount.

    Accepts a euro sign, blanks, a sign and proper thousands groups; at most two decimals.
    """
    clean = F.regexp_replace(text, r"(?U)^\s+|\s+$|[€ ]", "")
    digits = F.replace(F.regexp_substr(clean, F.lit(_AMOUNT)), F.lit(","), F.lit(""))
    # Two zeros more and two decimals kept without their point: cents, with no decimal arithmetic.
    cents = F.regexp_replace(F.concat(digits, F.lit("00")), r"\.([0-9]{2})[0-9]*$", "$1")
    return cents.try_cast("long")


def format_eur(cents: Column) -> Column:
    """`-€1,368.05` style text, by integer arithmetic only."""
    size = F.abs(cents)
    return F.concat(
        F.when(cents < 0, F.lit("-")).otherwise(F.lit("")),
        F.lit("€"),
        F.format_number(whole_div(size, F.lit(100)), 0),
        F.lit("."),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )


def plain_amount(cents: Column) -> Column:
    """`-1368.05` style text."""
    size = F.abs(cents)
    return F.concat(
        F.when(cents < 0, F.lit("-")).otherwise(F.lit("")),
        whole_div(size, F.lit(100)).cast("string"),
        F.lit("."),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )


def whole_div(numerator: Column, denominator: Column) -> Column:
    """Integer division towards zero: rounding down for amounts that are not negative."""
    return F.call_function("div", numerator, denominator)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, 21st."""
    suffix = (
        F.when((n % 100).between(10, 20), "th")
        .when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)
