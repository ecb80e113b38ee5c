"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data (default sf0.1), BENCH_CPUS the cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from patronly.catalog import QUERIES  # noqa: E402
from patronly.catalog.shop import Shop  # noqa: E402
from patronly.session import local_session  # noqa: E402

HEADLINE = [
    "order_features", "churn_table", "customer_summary", "customer_summary_n",
    "latest_warning", "customer_attribution_pct", "collapse_sessions_strict", "churn_crosstab",
    "revenue_bucket_summary", "order_bucket_by_product", "revenue_bucket_by_product", "segment_summary",
    "robust_scale", "kprototypes", "hierarchical_segments", "decision_tree", "boosted_churn", "export_orders",
]


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def build(spark, folder: str) -> float:
    """Raw tables to the stored order features and customer summary, which most queries redo."""
    start = time.perf_counter()
    Shop(spark, folder).stored_summary
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    run(spark, folder, "order_features")  # start-up of the JVM, not measured
    built = build(spark, folder)
    times = {name: run(spark, folder, name) for name in HEADLINE if name in QUERIES}
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "build": built, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
