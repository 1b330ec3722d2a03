"""What tables exist, how fresh they are, how their loads go."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.functions.timing import STALE_FACTOR, age_seconds, interval_column, stale_column
from kpiweave.operators.query import unpaged
from kpiweave.plans.loads import load
from kpiweave.plans.store import Manifest, TableStore, iso, new_run_id
from kpiweave.sources.landing import land
from kpiweave.specs import JobSpec, LoadCommand, QuerySpec

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("rows_written", T.LongType()),
        T.StructField("load_mode", T.StringType()),
        T.StructField("source_job", T.StringType()),
        T.StructField("watermark_value", T.StringType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("committed_at", T.TimestampNTZType()),
    ]
)
RUNS_SHOWN = 50


def registry(store: TableStore) -> DataFrame:
    """One row per committed table version."""
    base = f"{store.root}/registry"
    if not store.files.children(base):
        return store.spark.createDataFrame([], REGISTRY_SCHEMA)
    return store.spark.read.schema(REGISTRY_SCHEMA).json(f"{base}/*/*.json")


def latest_versions(versions: DataFrame, table: str = "table", version: str = "version") -> DataFrame:
    """The newest row per table; an aggregation, so no table's history is gathered."""
    newest = versions.groupBy(table).agg(F.max_by(F.struct("*"), F.col(version)).alias("newest"))
    return newest.select("newest.*")


def job_schedules(store: TableStore, jobs: Iterable[JobSpec]) -> DataFrame:
    rows = [(j.target_table, j.name, j.schedule.every) for j in jobs]
    return store.spark.createDataFrame(rows, "job_table string, job_name string, every string")


def with_staleness(
    latest: DataFrame, schedules: DataFrame, last_success: str, as_of: Column, factor: float = STALE_FACTOR
) -> DataFrame:
    """Registry rows with the interval of their job and a stale flag.

    ``latest`` has a ``table_name``; tables without a job count as hourly.
    """
    joined = latest.join(schedules, latest["table_name"] == schedules["job_table"], "left")
    interval = interval_column(F.col("every"))
    return joined.select(
        *[latest[c] for c in latest.columns],
        interval.alias("interval_s"),
        stale_column(F.col(last_success), interval, as_of, factor).alias("stale"),
    )


def catalog(store: TableStore, jobs: Iterable[JobSpec], as_of: datetime, factor: float = STALE_FACTOR) -> DataFrame:
    """Readable tables by name: row count, version, last load, staleness."""
    latest = latest_versions(registry(store)).select(
        F.col("table").alias("table_name"),
        "row_count",
        F.col("version").alias("table_version"),
        F.col("committed_at").alias("last_load_succeeded_at"),
        F.lit("success").alias("last_load_status"),
        F.col("watermark_value").alias("last_watermark_value"),
    )
    moment = F.lit(iso(as_of)).cast("timestamp_ntz")
    return with_staleness(latest, job_schedules(store, jobs), "last_load_succeeded_at", moment, factor).orderBy("table_name")


def table_detail(store: TableStore, table: str, sample: bool = False) -> dict:
    """Columns, version facts and optionally a 20-row sample frame."""
    head = store.manifest(table)
    columns = [{"name": f.name, "type": f.dataType.simpleString()} for f in head.struct.fields]
    return {
        "table_name": table,
        "columns": columns,
        "row_count": head.row_count,
        "table_version": head.version,
        "last_load_succeeded_at": head.committed_at,
        "last_watermark_value": head.watermark_value,
        "sample": store.sample(table) if sample else None,
    }


# --- runs --------------------------------------------------------------------------------


def newest_runs(runs: DataFrame, job: str, order: str, n: int = RUNS_SHOWN) -> DataFrame:
    """The last ``n`` runs of every job, numbered from the newest.

    Spark limits each job's rows before the shuffle, so a busy job costs no more than
    ``n`` rows per input partition.
    """
    from pyspark.sql import Window

    newest_first = Window.partitionBy(job).orderBy(F.col(order).desc())
    return runs.withColumn("nth", F.row_number().over(newest_first)).filter(F.col("nth") <= n)


def job_metrics(runs: DataFrame, as_of: Column, job: str = "job_name") -> DataFrame:
    """Per job: runs, failures, durations, rows, last success and its age."""
    ok = F.col("status") == "success"
    seconds = age_seconds(F.col("started_at"), F.col("finished_at"))
    last_success = F.max(F.when(ok, F.col("finished_at")))
    return (
        runs.groupBy(job)
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(ok).alias("succeeded"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.avg(seconds).alias("avg_seconds"),
            F.max(seconds).alias("max_seconds"),
            F.sum("rows_read").alias("rows_read"),
            F.sum("rows_written").alias("rows_written"),
            last_success.alias("last_success"),
        )
        .withColumn("age_seconds", age_seconds(F.col("last_success"), as_of))
    )


def overdue(metrics: DataFrame, schedules: DataFrame, job: str = "job_name", factor: float = STALE_FACTOR) -> DataFrame:
    """Jobs whose last success is older than their schedule allows."""
    joined = metrics.join(schedules.select("job_name", "every"), metrics[job] == schedules["job_name"], "left")
    limit = interval_column(F.col("every")) * F.lit(factor)
    late = F.col("age_seconds").isNull() | (F.col("age_seconds") > limit)
    return joined.filter(late).select(*[metrics[c] for c in metrics.columns], limit.alias("allowed_seconds"))


def stalled_marks(runs: DataFrame, job: str, mark: str, order: str, after: int = 3) -> DataFrame:
    """Jobs whose last ``after`` or more runs ended at one unchanged mark.

    Runs are first counted per (job, mark), which combines map-side; only the marks of a
    job meet afterwards.
    """
    per_mark = runs.groupBy(job, mark).agg(F.count(F.lit(1)).alias("runs"), F.max(order).alias("last_run"))
    # The mark of the latest run, with the number of runs that ended at it.
    current = per_mark.groupBy(job).agg(F.max_by(F.struct(mark, "runs"), F.col("last_run")).alias("now"))
    return current.select(job, F.col(f"now.{mark}").alias(mark), F.col("now.runs").alias("runs_at_mark")).filter(
        F.col("runs_at_mark") >= after
    )


# --- version-gated results -----------------------------------------------------------------


def result_key(spec: QuerySpec, version: int) -> str:
    """Names a result by table, version and query; asking for the SQL text changes nothing."""
    payload = {k: v for k, v in spec.to_json().items() if k != "include_sql"}
    digest = hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()
    return f"{spec.table}:{version}:{digest[:24]}"


def refresh_rollup(store: TableStore, name: str, spec: QuerySpec) -> tuple[Manifest, bool]:
    """Materialise a grouped query as a table, unless its input has not changed.

    Returns the rollup's version and whether it was rebuilt.
    """
    source = store.manifest(spec.table, spec.table_version_pin)
    key = result_key(spec, source.version)
    head = store.head(name)
    if head and head.note == key:
        return head, False
    rows = unpaged(store.read(spec.table, source.version), spec)
    run_id = new_run_id()
    landed = land(rows, store.landing_path(name, run_id))
    command = LoadCommand(run_id, name, "full", landed.path, rows_read=landed.rows_read, job_name=f"rollup_{name}")
    result = load(store, command, note=key, inputs={spec.table: source.version}, landed=landed)
    return store.manifest(name, result.table_version), True
