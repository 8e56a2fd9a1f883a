"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query is run in full into a sink that drops the rows. All run once to warm up, then each is
timed; the median of the timed runs is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerloom.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "reconciliation", "category_pareto", "merchant_pareto", "weekday_profile", "daily_spend", "burn_rate",
    "month_over_month", "month_surplus", "safe_to_spend", "cycle_spend", "policy_alerts", "bill_checklist",
    "recurring_charges", "statement_map", "row_ids", "append_once", "quarantine_rows", "effective_categories",
    "merchant_dimension", "weekly_windows", "secret_shapes",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:
        run(name)
    times = {}
    for name in names:
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
