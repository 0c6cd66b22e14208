"""Time the headline queries and print one JSON line.

Every query runs from the test tables to its last column, stages included.
"""

from __future__ import annotations

import json
import os
import time

from shelfspark.plans.catalog import QUERIES, forget_stages
from shelfspark.session import build_session

HEADLINE = [
    "sales_weekly", "inventory_weekly", "po_weekly", "promotion_weekly",
    "manual_override_weekly", "vendor_performance", "weekly_mart", "feature_table",
    "stockout_metrics", "reorder_actions", "kpi_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["week_spine"](spark, folder).count()  # start the JVM's code paths
    seconds = {}
    for name in HEADLINE:
        forget_stages()
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
