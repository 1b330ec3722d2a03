"""From a job's source to a DataFrame, by kind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiweave.functions.predicates import column_of, where
from kpiweave.operators.incremental import since
from kpiweave.operators.query import unpaged
from kpiweave.sources import csv_files, jdbc, synthetic
from kpiweave.sources.csv_files import InferredColumn, InferredSchema, json_row
from kpiweave.sources.sqlguard import check_select
from kpiweave.specs import JobSpec, QuerySpec, SpecError


@dataclass(frozen=True)
class Surroundings:
    """What a job refers to by id: JDBC options per connection, paths per upload."""

    connections: Mapping[Any, Mapping[str, Any]] = field(default_factory=dict)
    uploads: Mapping[str, str | Sequence[str]] = field(default_factory=dict)
    as_of: datetime | None = None

    def connection(self, key: Any) -> Mapping[str, Any]:
        if key not in self.connections:
            raise LookupError(f"connection {key!r} not found")
        return self.connections[key]

    def upload(self, key: str) -> str | Sequence[str]:
        if key not in self.uploads:
            raise LookupError(f"upload {key!r} not found")
        return self.uploads[key]


def _csv(spark: SparkSession, job: JobSpec, around: Surroundings, mark: str | None) -> DataFrame:
    source = job.source
    frame = csv_files.read_csv(
        spark, around.upload(source.upload_id), types=source.options.get("types"), schema=source.options.get("schema")
    )
    frame = where(frame, source.filters)
    if source.columns:
        frame = frame.select(*[column_of(frame.schema, c) for c in source.columns])
    return frame


def _relational(spark: SparkSession, job: JobSpec, around: Surroundings, mark: str | None) -> DataFrame:
    source = job.source
    options = around.connection("oracle" if source.kind == "oracle" else source.connection_id)
    frame = jdbc.read_jdbc(spark, options, source, job.watermark, mark, job.guards)
    return jdbc.legacy_numeric(frame) if source.options.get("legacy_numeric") else frame


def _synthetic(spark: SparkSession, job: JobSpec, around: Surroundings, mark: str | None) -> DataFrame:
    source = job.source
    incremental = mark if job.watermark is not None else None
    moment = around.as_of or datetime.now()
    cells = int(source.options.get("cells", synthetic.CELLS))
    frame = synthetic.read_synthetic(spark, source.columns, moment, incremental, cells)
    return where(frame, source.filters)


READERS = {"csv": _csv, "connection": _relational, "oracle": _relational, "synthetic": _synthetic}


def read_source(spark: SparkSession, job: JobSpec, around: Surroundings, mark: str | None = None) -> DataFrame:
    """Rows of the job's source after ``mark``, before any cap."""
    reader = READERS.get(job.source.kind)
    if reader is None:
        raise SpecError(f"source kind {job.source.kind} is loaded as a transform")
    frame = reader(spark, job, around, mark)
    if job.watermark is not None and not job.source.is_rdbms and job.watermark.column in frame.columns:
        lag = job.source.options.get("lag")
        frame = since(frame, job.watermark.column, mark, lag)
    return summarised(frame, job)


def summarised(frame: DataFrame, job: JobSpec) -> DataFrame:
    """The rows grouped before they are landed, where the source's options ask for it."""
    wanted = job.source.options.get("aggregations")
    if not wanted:
        return frame
    query = {"table": job.target_table, "aggregations": wanted, "groupBy": job.source.options.get("groupBy") or []}
    return unpaged(frame, QuerySpec.from_json(query))


def preview_source(spark: SparkSession, job: JobSpec, around: Surroundings, n: int = 20) -> DataFrame:
    """A few source rows for review; nothing is written and no mark applies."""
    return read_source(spark, job, around).limit(n)


@dataclass(frozen=True)
class Validation:
    ok: bool
    columns: tuple[str, ...]
    warnings: tuple[str, ...] = ()
    rendered_sql: str | None = None


def validate_source(spark: SparkSession, job: JobSpec, around: Surroundings) -> Validation:
    """Dry run: names, types and statements are checked and no row is read.

    A database is not contacted; its statement is only rendered.
    """
    source = job.source
    if source.kind == "duckdb_query":
        checked = check_select(spark, source.transform_sql)
        return Validation(True, (), ("transform load: the SELECT runs over loaded tables",), checked.text)
    if source.kind == "csv":
        around.upload(source.upload_id)
        return Validation(True, source.columns, ("csv load is full-refresh by default",))
    if source.is_rdbms and ("oracle" in around.connections or source.kind == "connection"):
        options = around.connection("oracle" if source.kind == "oracle" else source.connection_id)
        if source.mode == "raw":
            rendered = jdbc.query_options(spark, options, source, job.watermark, None, bounded=source.kind == "oracle")
            return Validation(True, source.columns, ("raw SQL mode",), rendered["query"])
        rendered = jdbc.table_options(options, source, job.guards)
        columns = ", ".join(source.columns)
        return Validation(True, source.columns, (), f"SELECT {columns} FROM {rendered['dbtable']}")
    frame = read_source(spark, job, around)
    return Validation(True, tuple(frame.columns))


def infer_frame(frame: DataFrame, sample_rows: int = 20) -> InferredSchema:
    """Inferred schema of any source that knows its types (a database, a table)."""
    columns = tuple(InferredColumn(f.name, f.dataType.simpleString(), f.nullable) for f in frame.schema.fields)
    sample = tuple(json_row(r.asDict()) for r in frame.limit(sample_rows).collect())
    return InferredSchema(columns, sample_rows=sample)


def profile(frame: DataFrame) -> DataFrame:
    """One row per column: type, NULLs, rows and text range, in one pass over the data."""
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(frame.columns):
        column = F.col(f"`{name}`")
        measures += [F.count(column).alias(f"n{i}")]
        text = column.cast("string")
        measures += [F.min(text).alias(f"lo{i}"), F.max(text).alias(f"hi{i}")]
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            F.col("rows"),
            (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
            F.col(f"lo{i}").alias("min_text"),
            F.col(f"hi{i}").alias("max_text"),
        )
        for i, f in enumerate(frame.schema.fields)
    ]
    return frame.agg(*measures).select(F.inline(F.array(*entries)))
