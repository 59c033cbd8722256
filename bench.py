"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from hawkframe.catalog import all_queries
from hawkframe.session import local_session

HEADLINE = [
    "parse_events",
    "validate_events",
    "entropy_text",
    "conn_counts",
    "distinct_session",
    "distinct_window",
    "novel_port_30d",
    "payload_stats",
    "tumble_features_1h",
    "bytes_percentiles",
    "join_reputation",
    "join_ioc_multi",
    "range_geo",
    "attack_chain",
    "dedup_alerts",
    "rate_limit",
    "alert_groups",
    "latency_summary",
    "roc_auc",
    "kl_drift",
    "low_volume",
    "soft_vote",
    "case_rows",
    "siem_envelope",
    "extract_features",
    "score_events",
]


def run(query, spark, sf_dir: str) -> float:
    """Seconds to build and run a query to its last row and column."""
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    warm_runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores)
    queries = all_queries()
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(queries[name], spark, sf_dir), 3)
        warm[name] = round(statistics.median(run(queries[name], spark, sf_dir) for _ in range(warm_runs)), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    flagship = warm.get("score_events")
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": int(cores),
                "spark": spark.version,
                "events_per_second_scored": round(events / flagship, 1) if flagship else None,
            }
        )
    )


if __name__ == "__main__":
    main()
