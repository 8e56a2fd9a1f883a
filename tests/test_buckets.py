"""A ledger in buckets by account serves running totals, recurring charges and the daily number without an exchange of its rows."""

import pytest
from conftest import rows_of

from ledgerloom.operators import cycle, policy, recurring
from ledgerloom.plans import catalog
from ledgerloom.sources import star
from ledgerloom.sources.tables import keep_bucketed

FOLDER = "/root/testdata/sf0.001"
WORK = {
    "running totals": lambda ledger: policy.policy_progress(ledger, catalog.POLICIES, threshold=1_000, hot_rows=None),
    "recurring": lambda ledger: recurring.detect_recurring(ledger, catalog.EVENTS_AS_OF, catalog.EVENT_LIMITS),
    "daily number": lambda ledger: cycle.safe_to_spend(ledger, catalog.EVENTS_AS_OF, 900_000),
}


@pytest.fixture(scope="module")
def ledgers(spark, tmp_path_factory):
    plain = star.event_ledger(spark, FOLDER)
    changed = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in changed.items():
        spark.conf.set(name, value)
    yield plain, keep_bucketed(plain, "bucketed", tmp_path_factory.mktemp("b"), ["account_id"], 4)
    for name in changed:
        spark.conf.unset(name)


def exchanges(df):
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "account_id" in line]


@pytest.mark.parametrize("name", sorted(WORK))
def test_no_exchange_on_the_account(ledgers, name):
    plain, bucketed = ledgers
    got, want = WORK[name](bucketed), WORK[name](plain)
    assert exchanges(got) == [] and exchanges(want) != []
    columns = [c for c in want.columns if c != "booking_ts"]
    assert rows_of(got, *columns) == rows_of(want, *columns)
