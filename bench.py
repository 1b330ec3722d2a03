"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
BENCH_RUNS    timed runs per query, the best counts (default 2)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kpiweave.session import build_session  # noqa: E402
from kpiweave.workload import all_entries  # noqa: E402

HEADLINE = (
    "kpi_by_hour_and_region",
    "project_columns",
    "filter_conjunction",
    "filter_like",
    "aggregate_sum",
    "aggregate_avg",
    "aggregate_median",
    "aggregate_median_wide",
    "aggregate_stddev",
    "aggregate_counts",
    "aggregate_global",
    "sort_descending",
    "page_three",
    "top_customers",
    "extract_oldest",
    "widget_traffic_lines",
    "widget_cell_table",
    "facts_with_sites",
    "map_grid",
    "run_history",
    "run_metrics",
    "newest_versions",
    "select_joins",
    "select_windows",
    "load_append",
    "load_upsert",
    "load_upsert_days",
    "load_incremental",
    "retention_window",
    "rebuild_from_landing",
    "csv_read_back",
    "stream_upsert",
)


def timed(spark, run, folder: str) -> float:
    began = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = all_entries()
    seconds = {}
    for name in HEADLINE:
        timed(spark, entries[name].run, folder)  # warm up code generation and file caches
        seconds[name] = round(min(timed(spark, entries[name].run, folder) for _ in range(runs)), 4)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
