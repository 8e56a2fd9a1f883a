"""Column layouts of the stored tables. Readers always pass a schema; none is inferred."""

from pyspark.sql import types as T

_S, _L, _D, _TS, _I = T.StringType(), T.LongType(), T.DateType(), T.TimestampType(), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LEDGER = _schema(
    id=_S, account_id=_S, booking_date=_D, value_date=_D, amount_cents=_L, currency=_S,
    merchant_raw=_S, merchant_key=_S, description=_S, source=_S, batch_id=_S, batch_ord=_L,
    inserted_at=_TS, booking_month=_S,
)
QUARANTINE = _schema(source=_S, reason=_S, raw=_S, account_id=_S, seen_at=_TS, fingerprint=_S)
MERCHANTS = _schema(
    merchant_key=_S, first_seen=_D, category=_S, categorized_by=_S, confidence=T.DoubleType()
)
LABEL_EVENTS = _schema(
    event_id=_S, actor_id=_S, scope=_S, txn_id=_S, merchant_key=_S, category=_S, ts=_TS
)
LABEL_LOG = T.StructType([*LABEL_EVENTS.fields, T.StructField("stream_batch", _L)])
ALERT_LOG = _schema(
    kind=_S, account_id=_S, subject_id=_S, policy=_S, period_key=_S, text=_S, created_at=_TS, stream_batch=_L
)
POLICY_SUMS = _schema(
    account_id=_S, ord=_L, month=_D, booking_date=_D, batch_id=_S, cents=_L, charges=_L, booking_month=_S, stream_batch=_L
)
STORED_IDS = _schema(id=_S, stream_batch=_L, slot=_I)
PAYDAY_OVERRIDE = _schema(account_id=_S, cycle_month=_D, actual_date=_D, ts=_TS)
SOURCE_CURSOR = _schema(account_id=_S, high_water=_D, coverage_start=_D)
CURSOR_LOG = _schema(account_id=_S, high_water=_D, coverage_start=_D, stream_batch=_L)
INGEST_AUDIT = _schema(
    file_path=_S, submitted=_L, skipped=_L, quarantined=_L, clipped=_L, new=_L, duplicate=_L, loaded_at=_TS
)

# One bank-feed record. `remittance_information` is read as text because banks send either a
# string or an array of strings; sources.feed turns both into an array. `_corrupt_record` is the line itself
# where it is no record.
FEED = T.StructType([
    T.StructField("account_id", _S),
    T.StructField("entry_reference", _S),
    T.StructField("booking_date", _S),
    T.StructField("value_date", _S),
    T.StructField("transaction_amount", _schema(amount=_S, currency=_S)),
    T.StructField("credit_debit_indicator", _S),
    T.StructField("status", _S),
    T.StructField("creditor", _schema(name=_S)),
    T.StructField("debtor", _schema(name=_S)),
    T.StructField("remittance_information", _S),
    T.StructField("_corrupt_record", _S),
])
