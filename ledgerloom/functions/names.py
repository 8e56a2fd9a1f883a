"""Merchant names: the lookup key and the display form, as regex expressions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# How card processors mark a name, and the places and codes cut from its end.
STARRED_PREFIXES = ("SUMUP", "SQ", "PAYPAL", "GOOGLE", "CRV")
GLUED_PREFIXES = ("ZETTLE_", "VDP-", "VDC-", "VDA-")
SPACED_PREFIXES = ("APPLE.COM/BILL", "POS")
PLACES = (
    "DUBLIN", "CORK", "GALWAY", "LIMERICK", "WATERFORD", "KILKENNY", "BRAY", "SWORDS", "TALLAGHT",
    "DUNDRUM", "BLANCHARDSTOWN", "MAYNOOTH", "IE", "IRL", "IRELAND",
)
TRAILING_CODES = (
    r"#?\d+",
    r"\d{1,2}[A-Z]{3}\d{0,4}",
    r"\d{1,2}/\d{1,2}(?:/\d{2,4})?",
    r"D\d{1,2}",
)


@dataclass(frozen=True)
class NameRules:
    starred: tuple[str, ...] = STARRED_PREFIXES
    glued: tuple[str, ...] = GLUED_PREFIXES
    spaced: tuple[str, ...] = SPACED_PREFIXES
    places: tuple[str, ...] = PLACES
    codes: tuple[str, ...] = TRAILING_CODES

    def __post_init__(self) -> None:
        if any(" " in place for place in self.places):
            raise ValueError("a place is one word")

    @property
    def prefix_pattern(self) -> str:
        """Any number of prefixes with something after each. Possessive, so long names need no stack."""
        forms = [rf"{_any(self.starred)}\s*\*\s*", rf"{_any(self.glued)}\s*", rf"{_any(self.spaced)}\s+"]
        return rf"^(?:(?:{'|'.join(forms)})(?=\S))++"

    @property
    def code_pattern(self) -> str:
        return rf"(?U)^(?:{'|'.join(self.codes)})$"


DEFAULT_NAME_RULES = NameRules()


def _any(words: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(re.escape(w) for w in words)})"


def upper_collapsed(raw: Column) -> Column:
    """Upper case with every run of white space as one blank."""
    return F.trim(F.regexp_replace(F.upper(raw), r"(?U)[\s\x1c-\x1f]+", " "))


# Everything from the first brace on, unless nothing stands before it.
_ANNOTATION = r"^([^{]*[^{\s])\s*\{.*$"


def display_name(raw: Column) -> Column:
    """The raw name without the bank's {…} annotation, case kept; empty for null."""
    head = F.regexp_replace(F.substring_index(raw, "{", 1), r"(?U)^\s+|\s+$", "")
    return F.coalesce(head, F.lit(""))


def identity_name(raw: Column) -> Column:
    """Upper-case name before the annotation: what tells two merchants with one key apart."""
    return upper_collapsed(display_name(raw))


def merchant_key(raw: Column, rules: NameRules = DEFAULT_NAME_RULES) -> Column:
    """Stable lookup key of a merchant name; empty for null or blank. Applying it twice changes nothing."""
    name = F.regexp_replace(upper_collapsed(F.coalesce(raw, F.lit(""))), _ANNOTATION, "$1")
    bare = F.regexp_replace(name, rules.prefix_pattern, "")
    kept = F.get(F.transform(F.array(F.split(bare, " ")), lambda tokens: _without_tail(tokens, rules)), 0)
    return F.when(kept.rlike("[A-Z]"), kept).otherwise(name)


def _without_tail(tokens: Column, rules: NameRules) -> Column:
    """The tokens before the codes and places at the end, in one pass over them.

    A code may go whenever one token stays, a place only when two stay.
    """
    def may_go(token: Column, before: Column) -> Column:
        return (before > 0) & token.rlike(rules.code_pattern) | (before > 1) & token.isin(*rules.places)

    stay = F.array_max(F.transform(tokens, lambda t, i: F.when(may_go(t, i), 0).otherwise(i + 1)))
    return F.array_join(F.slice(tokens, 1, stay), " ")
