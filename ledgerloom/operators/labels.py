"""Owner corrections: requests by transaction reference, and the labels that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT_TAXONOMY, Taxonomy
from ledgerloom.operators.categorize import resolve_category

MIN_REF_CHARS = 6


def resolve_labels(requests: DataFrame, ledger: DataFrame, taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Find the transaction each request means and say how that went.

    `requests` has request_id, actor_id, ref, category, ts. A reference is the exact,
    case-sensitive start of an id. Ids are first held against the references' first characters, which
    lets nearly all of the ledger go; the rest are cut to the lengths in use with those characters and
    join on the whole reference, so an ambiguous one is counted map-side. Building this runs no job.
    """
    ref = F.trim("ref")
    wanted = requests.withColumns({"ref": ref, "_category": resolve_category(F.col("category"), taxonomy)})
    refs = wanted.filter(F.length("ref") >= MIN_REF_CHARS).select("ref").distinct()
    begin = F.substring("ref", 1, MIN_REF_CHARS)
    begins = refs.groupBy(begin.alias("_begin")).agg(F.collect_set(F.length("ref")).alias("_lengths"))
    reached = F.filter("_lengths", lambda n: n <= F.length("id"))
    found = (
        ledger.select("id", "merchant_key", F.substring("id", 1, MIN_REF_CHARS).alias("_begin")).join(begins, "_begin")
        .select("id", "merchant_key", F.explode(reached).alias("_n"))
        .select("id", "merchant_key", F.substring(F.col("id"), F.lit(1), F.col("_n")).alias("ref"))
        .join(refs, "ref")
        .groupBy("ref").agg(F.count("*").alias("_hits"),
                            F.min(F.struct("id", "merchant_key")).alias("_hit"))
    )
    rows = wanted.join(found, "ref", "left")
    status = (
        F.when(F.col("_category").isNull(), "unknown_category")
        .when(F.length("ref") < MIN_REF_CHARS, "too_short")
        .when(F.col("_hits").isNull(), "not_found")
        .when(F.col("_hits") > 1, "ambiguous")
        .otherwise("ok")
    )
    settled = rows.withColumn("status", status)
    ok = F.col("status") == "ok"
    return settled.select(
        "request_id", "actor_id", "ref", F.coalesce("_category", "category").alias("category"), "status",
        F.when(ok, F.col("_hit.id")).alias("txn_id"),
        F.when(ok, F.col("_hit.merchant_key")).alias("merchant_key"), "ts")


def label_events(resolved: DataFrame, scopes: tuple[str, ...] = ("txn", "merchant")) -> DataFrame:
    """Events of the successful requests.

    With both scopes a request overrides its transaction and teaches the merchant; with `("txn",)`
    the merchant keeps its usual category.
    """
    def event(scope: str, txn: Column, merchant: Column) -> Column:
        return F.struct(
            F.concat_ws("|", "request_id", F.lit(scope)).alias("event_id"), F.lit(scope).alias("scope"),
            txn.alias("txn_id"), merchant.alias("merchant_key"))

    none = F.lit(None).cast("string")
    events = []
    if "txn" in scopes:
        events.append(event("txn", F.col("txn_id"), none))
    if "merchant" in scopes:
        events.append(F.when(F.col("merchant_key").isNotNull(), event("merchant", none, F.col("merchant_key"))))
    return (
        resolved.filter(F.col("status") == "ok")
        .select("actor_id", "category", "ts", F.explode(F.array_compact(F.array(*events))).alias("_e"))
        .select("_e.event_id", "actor_id", "_e.scope", "_e.txn_id", "_e.merchant_key", "category", "ts")
    )


def override_one(requests: DataFrame, ledger: DataFrame, category: str = "Dates",
                 taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> DataFrame:
    """Events that set one category on single transactions only."""
    fixed = requests.withColumn("category", F.lit(category))
    return label_events(resolve_labels(fixed, ledger, taxonomy), ("txn",))


def authorized(events: DataFrame, actors: DataFrame) -> DataFrame:
    """Events whose sender may act; the sender counts, not the channel."""
    return events.join(actors.select("actor_id").distinct(), "actor_id", "left_semi").select(*events.columns)


def _latest(events: DataFrame, scope: str, subject: str) -> DataFrame:
    return (
        events.filter(F.col("scope") == scope).groupBy(subject)
        .agg(F.max_by("category", F.struct("ts", "event_id")).alias("category"))
    )


def latest_overrides(events: DataFrame) -> DataFrame:
    """Current override per transaction. Latest wins, so a repeated event changes nothing."""
    return _latest(events, "txn", "txn_id")


def latest_labels(events: DataFrame) -> DataFrame:
    """Current label per merchant, ready for `categorize`."""
    return _latest(events, "merchant", "merchant_key").withColumns({
        "by": F.lit("manual"), "confidence": F.lit(1.0)})
