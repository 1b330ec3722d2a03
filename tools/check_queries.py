"""Compare registered queries with their SQL on DuckDB.

    python tools/check_queries.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from kpiweave.session import build_session  # noqa: E402
from kpiweave.workload import all_entries  # noqa: E402


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def compare(spark, connection, name: str, item, folder: str) -> str | None:
    frame = item.run(spark, folder)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    if item.sql is None:
        return None
    cursor = connection.execute(item.sql)
    names = [d[0] for d in cursor.description]
    want = canonical(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    kinds = dict(zip(names, [str(d[1]) for d in cursor.description], strict=True))
    if got != want:
        first = next(((g, w) for g, w in zip(got, want, strict=False) if g != w), (got[-1:], want[-1:]))
        return f"{len(got)} rows against {len(want)}; first difference {first}; {kinds}"
    return None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle(folder)
    bad = 0
    for name, item in all_entries().items():
        if chosen and name not in chosen:
            continue
        began = time.time()
        try:
            problem = compare(spark, connection, name, item, folder)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
