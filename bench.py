"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of parquet tables, BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import os
import time

from metricloom.plans.queries import QUERIES
from metricloom.session import build_session

HEADLINES = [
    "profile_numeric_stats",
    "profile_top_values",
    "profile_distinct",
    "table_classes",
    "key_check",
    "fk_orphans",
    "metric_count_monthly",
    "metric_sum_quarterly",
    "metric_rate",
    "metric_cumulative",
    "metric_dimension_split",
    "metric_cross_table",
    "fact_breakdown",
    "eval_metrics",
    "eval_family",
    "duplicate_sql",
    "fk_coverage",
    "patched_ranges",
    "refine_actions",
    "broker_window",
    "fuzzy_match",
    "catalogue_scores",
    "catalogue_ranking",
    "catalogue_violations",
    "submission_gate",
    "query_log_dedup",
    "ledger_totals",
    "calls_per_minute",
    "trailing_tokens",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "metricloom-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    # Start-up and first compilation are no part of any query.
    QUERIES["metric_count_monthly"](spark, folder).collect()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
