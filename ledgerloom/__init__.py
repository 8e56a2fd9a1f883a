"""Ledger analytics as Spark DataFrame jobs."""

from ledgerloom.config import Bill, Policy, Rule, Taxonomy

__all__ = ["Bill", "Policy", "Rule", "Taxonomy"]
