"""Structured Streaming jobs: ingest, alerts and label events.

Progress is the stream's checkpoint. A batch may run again after a lost executor or driver, so
every sink either anti-joins what is stored or overwrites the partition named after its batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom import schema
from ledgerloom.config import DEFAULT_TAXONOMY, INFLOW_EXCLUDE_CENTS, Bill, Policy, Taxonomy
from ledgerloom.functions.dates import month_key
from ledgerloom.functions.names import DEFAULT_NAME_RULES, NameRules
from ledgerloom.operators.bills import bill_alerts, bill_state
from ledgerloom.operators.ingest import (
    accepted, advance_cursor, append_new, assign_ids, checked, clip_boundary, clip_overlap, ingest_audit, map_feed,
    map_statements, quarantine, rejected, to_ledger,
)
from ledgerloom.operators.labels import authorized
from ledgerloom.operators.policy import policy_alerts, unsent
from ledgerloom.operators.progress import TOTALS, alerts_from_state, progress_sums
from ledgerloom.operators.spend import KEYS
from ledgerloom.plans.shapes import first_per_key, not_stored
from ledgerloom.sources.feed import numbered, stream_feed
from ledgerloom.sources.idstore import unstored, write_ids
from ledgerloom.sources.statements import read_statements
from ledgerloom.sources.tables import keep, read_table, write_table


@dataclass(frozen=True)
class Paths:
    """Where the tables of one deployment live."""

    root: str

    def __getattr__(self, name: str) -> str:
        return f"{self.root}/{name}"


def source_cursor(spark: SparkSession, paths: Paths, before: int | None = None) -> DataFrame:
    """Where each account stands, from the log of all batches, or of those before one.

    A cursor never goes back, so the state is a maximum and a minimum over the log.
    """
    log = read_table(spark, paths.cursor_log, schema.CURSOR_LOG)
    if before is not None:
        log = log.filter(F.col("stream_batch") < before)
    return log.groupBy("account_id").agg(F.max("high_water").alias("high_water"), F.min("coverage_start").alias("coverage_start"))


def _log_cursor(rows: DataFrame, batch_id: int, paths: Paths) -> None:
    """Advance the cursor by the accepted rows of a batch; the first batch of an account starts its coverage."""
    held = source_cursor(rows.sparkSession, paths, batch_id)
    pulls = rows.groupBy("account_id").agg(F.min("booking_date").alias("since")).withColumn("truncated", F.lit(False))
    moved = advance_cursor(held, rows, pulls).join(pulls.select("account_id"), "account_id", "left_semi")
    write_table(moved.withColumn("stream_batch", F.lit(batch_id).cast("long")), paths.cursor_log, "overwrite", ["stream_batch"])


def ingest_batch(batch: DataFrame, paths: Paths, currency: str = "EUR",
                 names: NameRules = DEFAULT_NAME_RULES, batch_id: int = 0, id_slots: int | None = None) -> None:
    """Map, check, number, dedupe and store one micro-batch; bad rows go to quarantine, the cursor moves on.

    With `id_slots` stored ids are kept in so many slots of their hash (`sources.idstore`), and a batch reads those it
    asks for instead of the ids of the ledger. The store must then have been kept from the first batch on.
    """
    spark = batch.sparkSession
    mapped = checked(map_feed(batch, currency), currency).persist()
    good = to_ledger(assign_ids(accepted(mapped)), F.current_timestamp(), names).persist()
    try:
        good.count()  # so that Spark knows how little a batch asks of the ledger
        stored = read_table(spark, paths.ledger, schema.LEDGER)
        if id_slots is None:
            write_table(append_new(stored, good), paths.ledger, "append", ["booking_month"])
        else:
            fresh = first_per_key(good, ["id"], [F.col("batch_id"), F.col("batch_ord")])
            new = keep(unstored(fresh, paths.ids, stored, batch_id, id_slots), "fresh", paths.work)
            write_ids(new, paths.ids, batch_id, id_slots)
            write_table(new, paths.ledger, "append", ["booking_month"])
        held = read_table(spark, paths.quarantine, schema.QUARANTINE)
        bad = quarantine(rejected(mapped), held, seen_at=F.current_timestamp())
        write_table(bad, paths.quarantine, "append")
        _log_cursor(good, batch_id, paths)
    finally:
        good.unpersist()
        mapped.unpersist()


def _run(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def start_ingest(spark: SparkSession, source: str, paths: Paths, currency: str = "EUR",
                 names: NameRules = DEFAULT_NAME_RULES, id_slots: int | None = None) -> StreamingQuery:
    """Ingest the files that arrived since the last run.

    A file is never split over micro-batches, so numbering repeats per file is stable over replays.
    """
    return _run(stream_feed(spark, source), lambda df, n: ingest_batch(numbered(df), paths, currency, names, n, id_slots),
                paths.checkpoint_ingest)


def load_statements(spark: SparkSession, source: str, paths: Paths, account_map: dict[str, str] | DataFrame | None = None,
                    currency: str = "EUR", names: NameRules = DEFAULT_NAME_RULES, multi_line: bool = False) -> None:
    """Load statement files as one batch: read, map, check, clip against the feed, number, store, quarantine, audit.

    Loading the same files again stores nothing and audits every row as a duplicate. What was stored by this load is
    read back from the ledger by its batch ids, so the audit does not depend on cached rows.
    """
    loaded_at = F.lit(datetime.now(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp")
    stored = read_table(spark, paths.ledger, schema.LEDGER)
    boundary = clip_boundary(stored.filter(F.col("source") == "api"), source_cursor(spark, paths))
    read = read_statements(spark, source, multi_line)
    staged = keep(clip_overlap(checked(map_statements(read, account_map, currency), currency), boundary), "staged", paths.work)
    good = to_ledger(assign_ids(accepted(staged).drop("clipped")), loaded_at, names)
    write_table(append_new(stored, good), paths.ledger, "append", ["booking_month"])
    held = read_table(spark, paths.quarantine, schema.QUARANTINE)
    bad = quarantine(rejected(staged), held, ["account", "date", "debit", "credit", "descriptions"], loaded_at)
    write_table(bad, paths.quarantine, "append")
    batches = good.select("batch_id").distinct()
    new = read_table(spark, paths.ledger, schema.LEDGER).join(batches, "batch_id", "left_semi").select(
        F.regexp_replace("batch_id", r"^[^|]*\|", "").alias("file_path"))
    audit = ingest_audit(staged, new).withColumn("loaded_at", loaded_at)
    write_table(audit.select(*schema.INGEST_AUDIT.fieldNames()), paths.ingest_audit, "append")


def send_bill_alerts(ledger: DataFrame, bills: list[Bill], as_of: date, paths: Paths, accounts: DataFrame,
                     keys: list[str] = KEYS, **options) -> None:
    """Write the bill alerts of a day that no earlier day has written: once for each bill, due date and kind.

    Running a day again replaces what it wrote.
    """
    state = bill_state(ledger, bills, as_of, accounts=accounts, keys=keys, **options)
    rows = bill_alerts(state, keys).select(
        F.concat(F.lit("bill_"), "kind").alias("kind"), *keys, F.col("bill").alias("subject_id"),
        F.lit(None).cast("string").alias("policy"), "period_key", "text", F.current_timestamp().alias("created_at"))
    day = as_of.toordinal()
    log = read_table(ledger.sparkSession, paths.bill_log, schema.ALERT_LOG).filter(F.col("stream_batch") != day)
    write_table(unsent(rows, log, [*keys, "period_key"]).withColumn("stream_batch", F.lit(day).cast("long")),
                paths.bill_log, "overwrite", ["stream_batch"])


def alert_batch(fresh: DataFrame, batch_id: int, paths: Paths, categorize: Callable[[DataFrame], DataFrame],
                policies: list[Policy], keys: list[str] = KEYS, threshold: int = INFLOW_EXCLUDE_CENTS,
                taxonomy: Taxonomy = DEFAULT_TAXONOMY, as_of: date | None = None) -> None:
    """Alerts for newly stored rows.

    The running totals are recomputed for the accounts and months the new rows touch, so a row that
    arrives late gets the total at its own place and rows after it do not fire again. The months reach the
    scan of the ledger as partitions pruned by the join. With `as_of` only that month is judged.
    """
    spark = fresh.sparkSession
    touched = fresh.select(*keys, "booking_month").distinct()
    around = read_table(spark, paths.ledger, schema.LEDGER).join(touched, [*keys, "booking_month"], "left_semi")
    alerts = policy_alerts(categorize(around), policies, as_of, new_ids=fresh.select("id").distinct(), keys=keys,
                           threshold=threshold, taxonomy=taxonomy)
    _log_alerts(alerts, batch_id, paths, keys)


def _log_alerts(alerts: DataFrame, batch_id: int, paths: Paths, keys: list[str]) -> None:
    """Write the alerts that no other batch has written, in place of what this batch wrote before."""
    rows = alerts.select(
        F.lit("policy_alert").alias("kind"), *keys, F.col("id").alias("subject_id"), "policy",
        F.col("month").alias("period_key"), "text", F.current_timestamp().alias("created_at"))
    log = read_table(alerts.sparkSession, paths.alert_log, schema.ALERT_LOG)
    earlier = log.filter(F.col("stream_batch") != batch_id)
    write_table(unsent(rows, earlier).withColumn("stream_batch", F.lit(batch_id).cast("long")),
                paths.alert_log, "overwrite", ["stream_batch"])


def _sums_before(spark: SparkSession, paths: Paths, batch_id: int, keys: list[str]) -> DataFrame:
    fields = [f for f in schema.POLICY_SUMS if f.name in keys or f.name != "account_id"]
    log = read_table(spark, paths.policy_sums, schema.T.StructType(fields))
    return log.filter(F.col("stream_batch") != batch_id)


def kept_alert_batch(fresh: DataFrame, batch_id: int, paths: Paths, categorize: Callable[[DataFrame], DataFrame],
                     policies: list[Policy] | DataFrame, keys: list[str] = KEYS, threshold: int = INFLOW_EXCLUDE_CENTS,
                     taxonomy: Taxonomy = DEFAULT_TAXONOMY, silent: bool = False) -> None:
    """Alerts for newly stored rows from kept sums (see `operators.progress`); the ledger is not read.

    The sums of this batch are written last and under its number, and read without it, so a batch that runs again
    finds what it found before. Sums are partitioned by month, of which a batch reads those that it touches. With
    `silent` rows only count and nothing is sent, as before alerts run for the first time.
    """
    spark = fresh.sparkSession
    rows = categorize(fresh).persist()
    try:
        if not silent:
            months = rows.select("booking_month").distinct()
            state = _sums_before(spark, paths, batch_id, keys).join(months, "booking_month", "left_semi")
            alerts = alerts_from_state(rows, state, policies, keys, threshold, taxonomy=taxonomy)
            _log_alerts(alerts, batch_id, paths, keys)
        sums = progress_sums(rows, policies, keys, threshold, taxonomy)
        write_table(sums.withColumns({"booking_month": month_key(F.col("month")), "stream_batch": F.lit(batch_id).cast("long")}),
                    paths.policy_sums, "overwrite", ["booking_month", "stream_batch"])
    finally:
        rows.unpersist()


def rebuild_sums(spark: SparkSession, paths: Paths, categorize: Callable[[DataFrame], DataFrame], policies: list[Policy] | DataFrame,
                 months: list[str], keys: list[str] = KEYS, threshold: int = INFLOW_EXCLUDE_CENTS,
                 taxonomy: Taxonomy = DEFAULT_TAXONOMY) -> None:
    """Count months anew from the ledger, after corrections or new caps. Batches that run later add to the result.

    To be run while no alert stream runs: all rows stored by then must have been seen.
    """
    ledger = read_table(spark, paths.ledger, schema.LEDGER).filter(F.col("booking_month").isin(*months))
    sums = progress_sums(categorize(ledger), policies, keys, threshold, taxonomy).withColumns({
        "booking_month": month_key(F.col("month")), "stream_batch": F.lit(-1).cast("long")})
    fresh = keep(sums, "policy-sums", paths.work)
    held = read_table(spark, paths.policy_sums, schema.POLICY_SUMS).select("booking_month", "stream_batch").filter(
        F.col("booking_month").isin(*months) & (F.col("stream_batch") >= 0)).distinct()
    nothing = [F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in fresh.columns if c not in ("booking_month", "stream_batch", *TOTALS)]
    zeros = held.select(*nothing, *[F.lit(0).cast("long").alias(c) for c in TOTALS], "booking_month", "stream_batch")
    write_table(fresh.unionByName(zeros), paths.policy_sums, "overwrite", ["booking_month", "stream_batch"])


def start_kept_alerts(spark: SparkSession, paths: Paths, categorize: Callable[[DataFrame], DataFrame],
                      policies: list[Policy] | DataFrame, keys: list[str] = KEYS, threshold: int = INFLOW_EXCLUDE_CENTS,
                      taxonomy: Taxonomy = DEFAULT_TAXONOMY, silent: bool = False) -> StreamingQuery:
    """`start_alerts` at the cost of the new rows alone. `categorize` gets only those."""
    stream = spark.readStream.schema(schema.LEDGER).parquet(paths.ledger)
    return _run(stream, lambda df, n: kept_alert_batch(df, n, paths, categorize, policies, keys, threshold, taxonomy, silent),
                paths.checkpoint_alerts)


def start_alerts(spark: SparkSession, paths: Paths, categorize: Callable[[DataFrame], DataFrame],
                 policies: list[Policy], keys: list[str] = KEYS,
                 threshold: int = INFLOW_EXCLUDE_CENTS, taxonomy: Taxonomy = DEFAULT_TAXONOMY,
                 as_of: date | None = None) -> StreamingQuery:
    """Evaluate caps on ledger rows stored since the last run."""
    stream = spark.readStream.schema(schema.LEDGER).parquet(paths.ledger)
    return _run(stream, lambda df, n: alert_batch(df, n, paths, categorize, policies, keys, threshold, taxonomy,
                                                    as_of), paths.checkpoint_alerts)


def baseline_alerts(spark: SparkSession, paths: Paths) -> StreamingQuery:
    """Mark all stored rows as seen without evaluating them, before alerts run for the first time."""
    stream = spark.readStream.schema(schema.LEDGER).parquet(paths.ledger)
    return _run(stream, lambda df, n: None, paths.checkpoint_alerts)


def label_batch(batch: DataFrame, actors: DataFrame, paths: Paths) -> None:
    """Store the label events of authorized senders, each event once."""
    known = read_table(batch.sparkSession, paths.label_events, schema.LABEL_EVENTS)
    once = first_per_key(authorized(batch, actors), ["event_id"], [F.col("ts")])
    write_table(not_stored(once, known, ["event_id"]).select(*known.columns), paths.label_events, "append")


def start_bounded_labels(spark: SparkSession, source: str, actors: DataFrame, paths: Paths, delay: str = "7 days",
                         arrived: Column | None = None) -> StreamingQuery:
    """`start_labels` without holding each batch against all events stored so far.

    The stream keeps the ids that arrived within `delay` and drops their repeats; a batch writes under its own number, so running it
    again changes nothing. Time is that of arrival, which never runs back, so an event is not lost however old its own `ts`.
    A repeat that comes later than the delay is stored once more and changes no reading: `stored_labels` takes the first
    of each id. `arrived` may name another time that does not run back.
    """
    stream = authorized(spark.readStream.schema(schema.LABEL_EVENTS).json(source), actors)
    timed = stream.withColumn("_arrived", F.current_timestamp() if arrived is None else arrived)
    once = timed.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["event_id"]).drop("_arrived")

    def store(batch: DataFrame, batch_id: int) -> None:
        write_table(batch.withColumn("stream_batch", F.lit(batch_id).cast("long")), paths.label_log, "overwrite", ["stream_batch"])

    return _run(once, store, paths.checkpoint_label_log)


def stored_labels(spark: SparkSession, paths: Paths) -> DataFrame:
    """The events that `start_bounded_labels` stored, each id once: as it came first."""
    log = read_table(spark, paths.label_log, schema.LABEL_LOG)
    order = F.struct("stream_batch", *[c for c in schema.LABEL_EVENTS.fieldNames() if c != "event_id"])
    first = log.groupBy("event_id").agg(F.min(order).alias("_first"))
    return first.select(*[F.col(c if c == "event_id" else f"_first.{c}").alias(c) for c in schema.LABEL_EVENTS.fieldNames()])


def start_labels(spark: SparkSession, source: str, actors: DataFrame, paths: Paths) -> StreamingQuery:
    stream = spark.readStream.schema(schema.LABEL_EVENTS).json(source)
    return _run(stream, lambda df, _: label_batch(df, actors, paths), paths.checkpoint_labels)
