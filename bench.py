"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores). Each query runs once to
warm up and then is timed; its whole result is written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from logtide.catalog import all_queries
from logtide.session import build_session

HEADLINE = [
    "P1_tolerant_json", "P7_normalise", "P15_multiline", "W2_level_counts", "W4_percentiles",
    "W7_top_errors", "W9_late_rows", "W12_roll_up", "W13_service_windows", "W13_service_minutes",
    "B1_ewma", "D1_z_scores", "D6_verdicts", "A1_cooldown", "A2_storms", "E4_detect_to_events",
    "L1_alert_limiter", "L2_request_limiter", "J1_log_samples", "J2_correlated", "J3_deployments",
    "J6_enriched", "R1_redact_documents", "R5_audit", "T1_fallback_report", "T5_dispatch",
    "Q1_list_anomalies", "Q3_search_logs", "M3_increase", "M5_histogram_quantile", "M13_group_notifications",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    timings: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(2):
            begin = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begin
            best = took if best is None else min(best, took)
        timings[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline queries, sum of seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
