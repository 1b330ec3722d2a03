"""Run records: small files, two per run, read back as a DataFrame."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.plans.store import TableStore, iso, utc_now

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("job_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("finished_at", T.TimestampNTZType()),
        T.StructField("rows_read", T.LongType()),
        T.StructField("rows_written", T.LongType()),
        T.StructField("watermark_before", T.StringType()),
        T.StructField("watermark_after", T.StringType()),
        T.StructField("landing_path", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Run:
    run_id: str
    table_name: str
    job_name: str | None = None
    attempt: int = 1
    status: str = "running"
    started_at: str | None = None
    finished_at: str | None = None
    rows_read: int = 0
    rows_written: int = 0
    watermark_before: str | None = None
    watermark_after: str | None = None
    landing_path: str | None = None
    error: str | None = None


def record(store: TableStore, run: Run) -> Run:
    state = "started" if run.status == "running" else "finished"
    name = run.run_id.replace("/", "_")
    store.files.put(f"{store.root}/runs/{run.table_name}/{name}.{state}.json", json.dumps(asdict(run)))
    return run


def begin(store: TableStore, **fields: Any) -> Run:
    return record(store, Run(started_at=iso(utc_now()), **fields))


def finish(store: TableStore, run: Run, status: str, **fields: Any) -> Run:
    values = {**asdict(run), **fields, "status": status, "finished_at": iso(utc_now())}
    return record(store, Run(**values))


def run_log(store: TableStore) -> DataFrame:
    """One row per run, in its last known state."""
    base = f"{store.root}/runs"
    if not store.files.children(base):
        return store.spark.createDataFrame([], RUN_SCHEMA)
    states = store.spark.read.schema(RUN_SCHEMA).json(f"{base}/*/*.json")
    whole = F.struct(*[F.col(n) for n in RUN_SCHEMA.names])
    done = F.when(F.col("status") == "running", 0).otherwise(1)
    last = states.groupBy("table_name", "run_id").agg(F.max_by(whole, done).alias("run"))
    return last.select("run.*")
