"""Time the SQL of the headline queries on DuckDB, on the same files and threads.

    python tools/measure_baseline.py [folder]
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from bench import HEADLINE  # noqa: E402
from kpiweave.workload import all_entries  # noqa: E402
from tools.check_queries import oracle  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    connection = oracle(folder)
    connection.execute(f"SET threads = {os.environ.get('BENCH_CPUS', '8')}")
    entries = all_entries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            connection.execute(entries[name].sql).fetchall()
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times[1:]), 4)
    print(json.dumps({"value": round(sum(seconds.values()), 3), "queries": seconds, "folder": folder}))


if __name__ == "__main__":
    main()
