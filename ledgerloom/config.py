"""Owner-written settings: taxonomy, rules, spending caps and bills.

These are short lists typed by a person. They are validated once when a job is built and become
literal expressions in the plan, so they never cost a join.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# Category names, bucket names and the roll-up must match for equal results.
CATEGORIES = (
    "Rent", "Utilities", "Groceries", "Dining", "FoodDelivery", "Coffee/Snacks", "Transport",
    "Subscriptions", "Health/Fitness", "Tools", "Shopping", "Cash", "Dates", "Travel", "Gifts",
    "Fees", "Transfers", "Income", "Other", "Uncategorized",
)
BUCKETS = ("Income", "Transfers", "Fixed", "Groceries", "FoodDelivery", "Other")
BUCKET_MEMBERS = {
    "Income": ("Income",),
    "Transfers": ("Transfers",),
    "Fixed": ("Rent", "Utilities", "Tools", "Health/Fitness", "Subscriptions", "Fees"),
    "Groceries": ("Groceries",),
    "FoodDelivery": ("FoodDelivery",),
}
BUCKET_LABELS = {"FoodDelivery": "Food delivery", "Other": "Misc."}

# Default thresholds, in cents and days.
RESIDUAL_GATE_CENTS = 20_000
INFLOW_EXCLUDE_CENTS = 10_000
SURPLUS_TARGET_CENTS = 100_000
GREEN_CENTS, RED_CENTS = 2_500, 1_000
EARLY_MATCH_DAYS, GRACE_DAYS = 5, 3
PAYDAY_DAY = 23
REPORT_WINDOW_DAYS = COVERAGE_WINDOW_DAYS = 90
SIZE_BANDS = (
    ("<€5", 0, 500), ("€5–15", 500, 1_500), ("€15–40", 1_500, 4_000),
    ("€40–100", 4_000, 10_000), (">€100", 10_000, None),
)


@dataclass(frozen=True)
class Taxonomy:
    """Categories and the buckets they roll up into; anything unmapped lands in `default_bucket`."""

    categories: tuple[str, ...] = CATEGORIES
    buckets: tuple[str, ...] = BUCKETS
    members: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(BUCKET_MEMBERS))
    labels: dict[str, str] = field(default_factory=lambda: dict(BUCKET_LABELS))
    default_bucket: str = "Other"
    uncategorized: str = "Uncategorized"
    income_bucket: str = "Income"
    non_spend_buckets: tuple[str, ...] = ("Income", "Transfers")
    fixed_bucket: str = "Fixed"
    discretionary: tuple[str, ...] = ("Groceries", "FoodDelivery", "Other")

    def __post_init__(self):
        unknown = (set(self.members) | {self.default_bucket}) - set(self.buckets)
        if unknown:
            raise ValueError(f"roll-up names unknown buckets: {sorted(unknown)}")

    def in_bucket(self, bucket: str) -> tuple[str, ...]:
        return tuple(self.members.get(bucket, ()))

    @property
    def non_spend(self) -> tuple[str, ...]:
        return tuple(c for b in self.non_spend_buckets for c in self.in_bucket(b))

    @property
    def fixed(self) -> tuple[str, ...]:
        return self.in_bucket(self.fixed_bucket)

    @property
    def income(self) -> tuple[str, ...]:
        return self.in_bucket(self.income_bucket)


DEFAULT_TAXONOMY = Taxonomy()


def _check_pattern(pattern: str, what: str) -> None:
    """Hold a pattern against the engine that will run it; without a session only against Python's."""
    try:
        session = SparkSession.getActiveSession() if isinstance(pattern, str) else None
        if session is None:
            re.compile(pattern)
        else:
            session.sql("SELECT '' RLIKE :pattern", args={"pattern": pattern}).collect()
    except (re.error, TypeError, PySparkException) as exc:
        raise ValueError(f"{what}: bad pattern {pattern!r}: {exc}") from None


def _whole(value, low: int, high: int | None = None) -> bool:
    is_int = isinstance(value, int) and not isinstance(value, bool)
    return is_int and value >= low and (high is None or value <= high)


@dataclass(frozen=True)
class Rule:
    pattern: str
    category: str

    def check(self, taxonomy: Taxonomy) -> None:
        _check_pattern(self.pattern, "rule")
        if self.category not in taxonomy.categories:
            raise ValueError(f"rule {self.pattern!r}: category {self.category!r} is unknown")


@dataclass(frozen=True)
class Policy:
    """A monthly cap on whatever one of `bucket`, `sub_label` or `pattern` selects."""

    name: str
    cap_monthly_cents: int
    bucket: str | None = None
    sub_label: str | None = None
    pattern: str | None = None

    def check(self, taxonomy: Taxonomy) -> None:
        chosen = [m for m in (self.bucket, self.sub_label, self.pattern) if m is not None]
        if len(chosen) != 1:
            raise ValueError(f"policy {self.name!r} needs exactly one matcher, has {len(chosen)}")
        if not _whole(self.cap_monthly_cents, 0):
            raise ValueError(f"policy {self.name!r}: cap must be whole cents")
        if self.bucket is not None and self.bucket not in taxonomy.buckets:
            raise ValueError(f"policy {self.name!r}: bucket {self.bucket!r} is unknown")
        if self.sub_label is not None and self.sub_label not in taxonomy.categories:
            raise ValueError(f"policy {self.name!r}: sub_label {self.sub_label!r} is unknown")
        if self.pattern is not None:
            _check_pattern(self.pattern, f"policy {self.name!r}")


@dataclass(frozen=True)
class Bill:
    name: str
    pattern: str
    due_day: int
    expected_cents: int
    tolerance_pct: int

    def check(self, taxonomy: Taxonomy) -> None:
        _check_pattern(self.pattern, f"bill {self.name!r}")
        if not _whole(self.due_day, 1, 31):
            raise ValueError(f"bill {self.name!r}: due_day must be 1 to 31")
        if not _whole(self.expected_cents, 1):
            raise ValueError(f"bill {self.name!r}: expected_cents must be positive whole cents")
        if not _whole(self.tolerance_pct, 0, 100):
            raise ValueError(f"bill {self.name!r}: tolerance_pct must be 0 to 100")


def build(kind, entries, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> list:
    """Turn mappings into checked `Rule`, `Policy` or `Bill` objects, in order."""
    names = {f.name for f in fields(kind)}
    out = []
    for position, entry in enumerate(entries, 1):
        label = f"{kind.__name__.lower()} #{position}"
        if not isinstance(entry, dict):
            raise ValueError(f"{label} must be a mapping")
        if set(entry) - names:
            raise ValueError(f"{label} has unknown key(s) {sorted(set(entry) - names)}")
        try:
            item = kind(**entry)
        except TypeError as exc:
            raise ValueError(f"{label} is missing a key: {exc}") from None
        item.check(taxonomy)
        out.append(item)
    return out


@dataclass(frozen=True)
class Dimensions:
    rules: list[Rule]
    policies: list[Policy]
    bills: list[Bill]
    grace_days: int


def load_dims(shared: str | Path, local: str | Path | None = None,
              taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> Dimensions:
    """Read the JSON settings files. Local entries come first and local scalars win."""
    layers = [json.loads(Path(p).read_text(encoding="utf-8")) for p in (local, shared)
              if p is not None and Path(p).exists()]
    for layer in layers:
        stray = set(layer) - {"rules", "policies", "bills", "grace_days"}
        if stray:
            raise ValueError(f"settings have unknown section(s) {sorted(stray)}")
    merged = {part: concat_dims(*(layer.get(part, []) for layer in layers))
              for part in ("rules", "policies", "bills")}
    grace = next((layer["grace_days"] for layer in layers if "grace_days" in layer), GRACE_DAYS)
    if not _whole(grace, 0):
        raise ValueError("grace_days must be a whole number of days")
    return Dimensions(
        rules=build(Rule, merged["rules"], taxonomy),
        policies=build(Policy, merged["policies"], taxonomy),
        bills=build(Bill, merged["bills"], taxonomy),
        grace_days=grace,
    )


def concat_dims(*layers: list) -> list:
    """Ordered concatenation: earlier layers keep their place ahead of later ones."""
    return [entry for layer in layers for entry in layer]


# Our own small starter rules; real deployments pass their own list.
STARTER_RULES = [
    Rule(r"\bUBER ?EATS\b|\bDELIVEROO\b", "FoodDelivery"),
    Rule(r"\b(SUPERMARKET|GROCER|GROCERY)\b", "Groceries"),
    Rule(r"\b(UBER|TAXI|BUS|RAIL|METRO)\b", "Transport"),
    Rule(r"\b(NETFLIX|SPOTIFY|YOUTUBE)\b", "Subscriptions"),
    Rule(r"\b(GYM|FITNESS|PHARMACY)\b", "Health/Fitness"),
    Rule(r"\b(ATM|CASH WITHDRAWAL)\b", "Cash"),
    Rule(r"\b(SALARY|PAYROLL)\b", "Income"),
]
