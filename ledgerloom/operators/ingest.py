"""From incoming rows to the ledger: mapping, checks, ids, append-once, quarantine, clip, cursor."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import iso_date, month_key, parse_date
from ledgerloom.functions.hashing import booking_id, booking_text, fingerprint
from ledgerloom.functions.money import parse_cents
from ledgerloom.functions.names import DEFAULT_NAME_RULES, NameRules
from ledgerloom.operators.merchants import with_merchant_key
from ledgerloom.operators.spend import KEYS
from ledgerloom.plans.shapes import (
    BLOCK_ROWS, HOT_ROWS, block_of, compute_once, first_per_key, not_stored, running_totals,
)

# States of a settled feed record, and the sources a ledger row may name.
BOOKED = ("BOOK", "BOOKED")
SOURCES = ("api", "csv")


def is_booked(status: Column) -> Column:
    """Settled, or not said; blank counts as not said."""
    return F.upper(F.coalesce(F.when(status != "", status), F.lit("BOOK"))).isin(*BOOKED)


def booked(feed: DataFrame) -> DataFrame:
    return feed.filter(is_booked(F.col("status")))


def map_accounts(df: DataFrame, account_map: Mapping[str, str] | DataFrame,
                 column: str = "account_label") -> DataFrame:
    """Add `account_id`: the mapped account, or the label itself.

    A mapping from the settings becomes literals. A table (label, account_id) is joined and left to
    Spark to broadcast or shuffle by its size.
    """
    if isinstance(account_map, DataFrame):
        table = account_map.select(F.col("label").alias(column), F.col("account_id").alias("_mapped"))
        return df.join(table, column, "left").withColumn(
            "account_id", F.coalesce("_mapped", column)).drop("_mapped")
    known = [F.when(F.col(column) == label, account) for label, account in account_map.items()]
    return df.withColumn("account_id", F.coalesce(*known, F.col(column)))


def map_statements(df: DataFrame, account_map: Mapping[str, str] | DataFrame | None = None,
                   currency: str = "EUR") -> DataFrame:
    """Statement text rows to ledger columns with a `status` of ok, skip or reject and a `reason`.

    Checks run in a fixed order, so a zero row with a bad date is skipped and not rejected. Reads
    account, date, debit, credit, type, currency and `descriptions` (array); all text.
    """
    def cell(name: str) -> Column:
        return F.trim(F.coalesce(name, F.lit("")))

    def size(text: Column) -> Column:
        return F.when(text == "", 0).otherwise(F.abs(parse_cents(text)))

    parts = F.filter(F.transform("descriptions", lambda x: F.trim(x)), lambda x: x != "")
    mapped = map_accounts(df.withColumn("account_label", cell("account")), account_map or {})
    parsed = compute_once(mapped, {
        "_pending": F.lower("type").rlike("pending|authori[sz]"),
        "_blank": (cell("debit") == "") & (cell("credit") == ""),
        "_cents": (size(cell("credit")) - size(cell("debit"))).cast("long"),
        "_currency": F.upper(cell("currency")),
        "booking_date": parse_date(F.col("date")),
        "_text": F.concat_ws(" ", parts),
    })
    cents, day = F.col("_cents"), F.col("booking_date")
    money = F.when(F.col("_currency") == "", currency).otherwise(F.col("_currency"))
    verdict = _verdict([
        ("skip", "pending", F.col("_pending")),
        ("skip", "no_amount", F.col("_blank")),
        ("reject", "bad_amount", cents.isNull()),
        ("skip", "zero_amount", cents == 0),
        ("reject", "no_account", F.col("account_id") == ""),
        ("reject", "foreign_currency", money != currency),
        ("reject", "bad_date", day.isNull()),
    ])
    text = F.nullif(F.col("_text"), F.lit(""))
    return parsed.select(
        *[c for c in df.columns if c != "currency"], "account_id", "booking_date",
        cents.alias("amount_cents"), money.alias("currency"), verdict["status"].alias("status"),
        verdict["reason"].alias("reason"), F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("date").alias("value_date"), text.alias("merchant_raw"), text.alias("description"),
        F.lit("csv").alias("source"))


def map_feed(feed: DataFrame, currency: str = "EUR") -> DataFrame:
    """Bank-feed records to ledger columns with `status` and `reason`, as for statements.

    A line that is no record (`_corrupt_record`) is rejected as unreadable and keeps its text as `raw`.
    """
    broken = F.col("_corrupt_record") if "_corrupt_record" in feed.columns else F.lit(None).cast("string")
    direction = F.upper(F.coalesce("credit_debit_indicator", F.lit("")))
    size = F.abs(parse_cents(F.coalesce("transaction_amount.amount", F.lit(""))))
    sign = F.when(direction == "DBIT", -1).when(direction == "CRDT", 1)
    day = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("booking_date", "value_date")])
    remittance = F.coalesce(
        F.from_json("remittance_information", "array<string>"), F.array("remittance_information"))
    parts = F.filter(F.transform(remittance, lambda x: F.trim(x)), lambda x: x != "")
    text = F.nullif(F.trim(F.concat_ws(" ", parts)), F.lit(""))
    money = F.upper(F.coalesce(F.nullif(F.col("transaction_amount.currency"), F.lit("")), F.lit("EUR")))
    kept = [c for c in feed.columns if c in ("account_id", "file_path", "batch_id", "batch_ord")]
    fields = sorted(c for c in feed.columns if c not in (*kept, "_corrupt_record"))
    raw = F.coalesce(broken, F.to_json(F.struct(*fields)))
    parsed = compute_once(feed, {
        "_size": size, "_sign": sign, "_dated": day.isNotNull(), "_day": iso_date(day), "_money": money, "_text": text})
    signed = F.col("_sign") * F.col("_size")
    party = F.when(signed < 0, F.col("creditor.name")).otherwise(F.col("debtor.name"))
    verdict = _verdict([
        ("reject", "unreadable", broken.isNotNull()),
        ("skip", "not_booked", ~is_booked(F.col("status"))),
        ("skip", "no_date", ~F.col("_dated")),
        ("reject", "bad_amount", F.col("_size").isNull()),
        ("reject", "no_direction", F.col("_sign").isNull()),
        ("reject", "no_account", F.trim(F.coalesce("account_id", F.lit(""))) == ""),
        ("reject", "foreign_currency", F.col("_money") != currency),
        ("reject", "bad_date", F.col("_day").isNull()),
    ])
    return parsed.select(
        *kept, F.nullif("entry_reference", F.lit("")).alias("id"), F.col("_day").alias("booking_date"),
        iso_date(F.col("value_date")).alias("value_date"), signed.cast("long").alias("amount_cents"),
        F.col("_money").alias("currency"), F.coalesce(F.nullif(party, F.lit("")), "_text").alias("merchant_raw"),
        F.col("_text").alias("description"), F.lit("api").alias("source"), verdict["status"].alias("status"),
        verdict["reason"].alias("reason"), raw.alias("raw"))


def _verdict(checks: list[tuple[str, str, Column]]) -> Column:
    """Struct of status and reason set by the first check that holds."""
    def outcome(status: str, reason: str | None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))

    chain = None
    for status, reason, holds in checks:
        chain = F.when(holds, outcome(status, reason)) if chain is None else chain.when(holds, outcome(status, reason))
    return chain.otherwise(outcome("ok", None))


def currency_gate(df: DataFrame, currency: str = "EUR") -> DataFrame:
    """Mark rows in another currency as rejected, so they are never summed."""
    foreign = F.upper(F.coalesce("currency", F.lit(currency))) != currency
    return df.withColumns({
        "status": F.when(foreign, "reject").otherwise("ok"),
        "reason": F.when(foreign, "foreign_currency"),
    })


def validate(df: DataFrame, currency: str = "EUR") -> DataFrame:
    """The row contract every source must meet, as `status` and `reason`; missing currency is filled in.

    Amounts and dates may still be text here: only whole cents and ISO dates pass.
    """
    cents = F.col("amount_cents").cast("string")
    day = F.col("booking_date").cast("string")
    whole = F.regexp_extract(cents, r"^[+-]?[0-9]+$", 0).try_cast("long")
    iso = iso_date(day)
    verdict = _verdict([
        ("reject", "bad_amount", whole.isNull()),
        ("reject", "bad_date", iso.isNull()),
        ("reject", "bad_source", ~F.coalesce("source", F.lit("")).isin(*SOURCES)),
        ("reject", "no_account", F.coalesce("account_id", F.lit("")) == ""),
    ])
    return df.withColumns({
        "status": verdict["status"], "reason": verdict["reason"],
        "amount_cents": whole, "booking_date": iso, "currency": F.coalesce("currency", F.lit(currency)),
    })


def checked(df: DataFrame, currency: str = "EUR") -> DataFrame:
    """Mapped rows held to the row contract: what was accepted and breaks it becomes a reject."""
    contract = validate(df.select("*", F.struct("status", "reason").alias("_was")), currency)
    ok = F.col("_was.status") == "ok"
    return contract.withColumns({
        "status": F.when(ok, F.col("status")).otherwise(F.col("_was.status")),
        "reason": F.when(ok, F.col("reason")).otherwise(F.col("_was.reason"))}).select(*df.columns)


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "ok").drop("status", "reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "reject")


def assign_ids(df: DataFrame, batch: str = "batch_id", position: str = "batch_ord",
               block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Bank reference, else a hash of the booking; identical rows of one batch are numbered.

    Numbers restart per batch, so reading a file again gives the same ids. One booking repeated a
    huge number of times is numbered block by block (see `running_totals`). Bookings meet by their text and are hashed
    after that, since a hash takes more room in a shuffle than the text.
    """
    text = booking_text(*(F.col(c) for c in ("booking_date", "amount_cents", "merchant_raw", "account_id")))
    referenced = F.nullif(F.col("id"), F.lit(""))
    rows = df.withColumns({
        "_booking": F.coalesce(F.concat(F.lit("ref|"), referenced), F.concat(F.lit("row|"), text)),
        "_block": block_of(F.col(position), block_rows),
    })
    numbered = running_totals(rows, ["_booking", batch], ["_block"], [position], {"_nth": F.lit(1)}, hot_rows)
    return numbered.withColumn("id", F.coalesce(referenced, booking_id(text, F.col("_nth") - 1))).select(*df.columns)


def append_new(ledger: DataFrame, batch: DataFrame, hashed_months: list[str] | None = None) -> DataFrame:
    """Rows of `batch` whose id the ledger does not hold; of repeats in the batch the first one.

    Copies of an id are pruned to one per task before the shuffle. Of the ledger only ids are read, and
    only those the batch asks for are kept (see `not_stored`). When all ids are hashes the date is part of
    them, so passing the batch's months lets the scan skip every other partition.
    """
    held = ledger
    if hashed_months is not None:
        held = held.filter(F.col("booking_month").isin(*hashed_months))
    fresh = first_per_key(batch, ["id"], [F.col("batch_id"), F.col("batch_ord")])
    return not_stored(fresh, held, ["id"]).select(*batch.columns)


def to_ledger(rows: DataFrame, loaded_at: Column, names: NameRules = DEFAULT_NAME_RULES) -> DataFrame:
    """Stored form of accepted rows: merchant key computed once here, month for partitioning.

    The stored batch id starts with the load time, so batches sort in the order they came whatever their files are called.
    """
    batch = F.concat_ws("|", F.date_format(loaded_at, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "batch_id")
    keyed = with_merchant_key(rows, names)
    return keyed.select(
        "id", "account_id", "booking_date", "value_date", "amount_cents", "currency", "merchant_raw",
        "merchant_key", "description", "source", batch.alias("batch_id"), "batch_ord", loaded_at.alias("inserted_at"),
        month_key(F.col("booking_date")).alias("booking_month"))


def combine(*sources: DataFrame) -> DataFrame:
    """Rows of several sources as one batch, aligned by column name."""
    first, *rest = sources
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def quarantine(bad: DataFrame, existing: DataFrame | None, payload: list[str] | None = None,
               seen_at: Column | None = None) -> DataFrame:
    """Rejected rows with their reason and original content, each stored once however often it is read."""
    raw = F.col("raw") if payload is None else F.to_json(
        F.struct(*sorted(payload)), {"ignoreNullFields": "false"})
    rows = bad.select(
        "source", "reason", raw.alias("raw"), "account_id",
        (seen_at if seen_at is not None else F.lit(None).cast("timestamp")).alias("seen_at"),
    ).withColumn("fingerprint", fingerprint(F.col("source"), F.col("raw")))
    once = first_per_key(rows, ["fingerprint"], [F.col("reason"), F.col("account_id")])
    if existing is None:
        return once
    return not_stored(once, existing, ["fingerprint"]).select(*rows.columns)


def quarantine_summary(quarantined: DataFrame) -> DataFrame:
    return quarantined.groupBy("source", "reason").agg(F.count("*").alias("rows"))


def clip_boundary(api_ledger: DataFrame, cursor: DataFrame | None, keys: list[str] = KEYS) -> DataFrame:
    """First date the feed already covers: its earliest row, or the recorded start of coverage when
    a backdated row lies before it."""
    earliest = api_ledger.groupBy(*keys).agg(F.min("booking_date").alias("_min"))
    if cursor is None:
        return earliest.withColumnRenamed("_min", "clip_before")
    recorded = cursor.groupBy(*keys).agg(F.min("coverage_start").alias("_start"))
    both = earliest.join(recorded, list(keys), "left") if keys else earliest.withColumn(
        "_start", recorded.scalar())
    late = F.when(F.col("_min") < F.col("_start"), F.col("_start")).otherwise(F.col("_min"))
    return both.select(*keys, late.alias("clip_before"))


def clip_overlap(statements: DataFrame, boundary: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Add `clipped`: the statement row lies on or after the date its account's feed covers.

    Where rows carry a `status`, those that were ok and are clipped get the status clipped, as the audit counts it.
    """
    if keys:
        rows = statements.join(boundary, list(keys), "left")
    else:
        rows = statements.withColumn("clip_before", boundary.scalar())
    rows = rows.withColumn("clipped", F.coalesce(
        F.col("booking_date") >= F.col("clip_before"), F.lit(False))).drop("clip_before")
    if "status" not in rows.columns:
        return rows
    return rows.withColumn("status", F.when(
        F.col("clipped") & (F.col("status") == "ok"), "clipped").otherwise(F.col("status")))


def advance_cursor(cursor: DataFrame, batch: DataFrame, pulls: DataFrame) -> DataFrame:
    """Cursor after a pull: the newest date seen, never going back, held where the pull was cut short.

    `pulls` has account_id, since, truncated. A first pull records where coverage begins; the
    earliest such date is kept.
    """
    seen = batch.groupBy("account_id").agg(F.max("booking_date").alias("_seen"))
    pulled = pulls.groupBy("account_id").agg(
        F.min("since").alias("_since"), F.bool_or("truncated").alias("_truncated"))
    rows = cursor.join(pulled, "account_id", "full").join(seen, "account_id", "left")
    moved = F.when(F.coalesce("_truncated", F.lit(False)), F.col("high_water")).otherwise(
        F.greatest("high_water", "_seen"))
    start = F.when(F.col("high_water").isNull(), F.least("coverage_start", "_since")).otherwise(
        F.col("coverage_start"))
    return rows.select("account_id", moved.alias("high_water"), start.alias("coverage_start"))


def pull_from(cursor: DataFrame, default_from: date, overlap_days: int) -> DataFrame:
    """Where the next read of each account starts: some days behind its cursor."""
    return cursor.withColumn("since", F.coalesce(
        F.date_sub("high_water", overlap_days), F.lit(default_from)))


def ingest_audit(staged: DataFrame, inserted: DataFrame, by: str = "file_path") -> DataFrame:
    """Per file: submitted, new, duplicate, skipped, quarantined and clipped rows.

    `staged` carries `status` with the values ok, skip, reject and clipped.
    """
    def tally(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    counts = staged.groupBy(by).agg(
        tally("ok").alias("submitted"), tally("skip").alias("skipped"),
        tally("reject").alias("quarantined"), tally("clipped").alias("clipped"))
    new = inserted.groupBy(by).agg(F.count("*").alias("_new"))
    joined = counts.join(new, by, "left").withColumn("new", F.coalesce("_new", F.lit(0)))
    return joined.withColumn("duplicate", F.col("submitted") - F.col("new")).drop("_new")
