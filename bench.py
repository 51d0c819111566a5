"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is built and run once to warm the JVM, then built and run again for the clock. Results
go to the no-op sink: all rows are computed, none are collected. A query that fails is listed under
``failed`` and costs no other figure; each time is also printed to stderr as it is taken.
"""

import json
import os
import sys
import tempfile
import time

from flowguard.plans import catalogue
from flowguard.session import get_session

HEADLINE = [
    "action_mix",
    "trust_scores",
    "policy_lookup",
    "json_payloads",
    "clean_training_table",
    "column_medians",
    "stratified_split",
    "anova_scores",
    "correlation_pairs",
    "selection_audit",
    "gaussian_bayes",
    "class_report",
    "binary_rank_metrics",
    "one_vs_rest_metrics",
    "evaluation_summary",
    "isotonic_calibration",
    "representative_rows",
    "class_neighbours",
    "oversampled_binary",
    "binary_forest_importances",
    "window_flow_features",
    "stream_scoring",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.checkpoint.dir": os.environ.get("BENCH_WORK_DIR") or tempfile.mkdtemp(prefix="bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        try:
            for _ in range(2):
                start = time.perf_counter()
                catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                took = round(time.perf_counter() - start, 3)
            times[name] = took
            print(name, took, file=sys.stderr, flush=True)
        except Exception as error:  # noqa: BLE001 - the other figures are still wanted
            failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
            print(name, failed[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "failed": failed, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
