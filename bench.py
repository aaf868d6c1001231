"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (default 2); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from zonedeck import plans
from zonedeck.session import build_session

HEADLINE = [
    "control_totals", "load_fixed", "field_occurs", "lookup_rrn", "check_equivalence", "reconcile", "payroll",
    "interest", "loan_payment", "post_amounts", "read_keyed", "rewrite_keyed", "insert_keyed", "browse_many",
    "assign_queue_items", "detect_constructs", "tag_rules", "substitute_blocks", "layout_census", "nearest",
    "retrieve", "refresh_plan", "content_hash", "attempt_rollup", "loss_spans", "control_totals_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")

    def once(name: str) -> float:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    medians, spreads = {}, {}
    for name in names:
        once(name)
        times = [once(name) for _ in range(runs)]
        medians[name] = round(statistics.median(times), 3)
        spreads[name] = round(max(times) - min(times), 3)
    print(json.dumps({
        "metric": "total_median_query_time", "value": round(sum(medians.values()), 3), "unit": "sec",
        "queries": medians, "spread": spreads, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
