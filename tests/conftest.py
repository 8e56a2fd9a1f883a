import sys
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerloom.operators.merchants import with_merchant_key  # noqa: E402

BOOKINGS = ("account_id string, booking_date date, merchant_raw string, amount_cents long, category string, "
            "batch_ord long")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ledger_of(spark):
    """Categorized ledger from (day, merchant, cents, category) rows of one account."""

    def build(rows, account="a1"):
        data = [(account, date.fromisoformat(d), m, c, cat, i) for i, (d, m, c, cat) in enumerate(rows)]
        df = spark.createDataFrame(data, BOOKINGS)
        return with_merchant_key(df).withColumns({
            "id": F.concat_ws("-", F.lit("t"), "batch_ord"), "batch_id": F.lit("b"),
            "booking_month": F.date_format("booking_date", "yyyy-MM")})

    return build


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
