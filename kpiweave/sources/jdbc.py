"""Relational sources through Spark's JDBC reader.

Filters, watermark and columns are DataFrame operations, which Spark pushes into the
database. Counts and sketches that cut a capped extract are not pushed: each reads the delta.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.functions.predicates import column_of, where
from kpiweave.operators.incremental import since
from kpiweave.specs import Guards, JobSource, SpecError, WatermarkSpec, check_name
from kpiweave.sources.sqlguard import check_select

FETCH_SIZE = 10_000
MARK = re.compile(r":watermark\b")

# Fixed texts of the databases' own catalogs: (columns, relation, condition).
TABLE_CATALOGS = {
    "oracle": "SELECT owner AS table_schema, table_name FROM all_tables",
    "derby": (
        "SELECT s.schemaname AS table_schema, t.tablename AS table_name"
        " FROM sys.systables t JOIN sys.sysschemas s ON t.schemaid = s.schemaid WHERE t.tabletype = 'T'"
    ),
    "default": "SELECT table_schema, table_name FROM information_schema.tables",
}


def database_kind(options: Mapping[str, Any]) -> str:
    """The product name inside a JDBC URL."""
    pieces = str(options.get("url", "")).split(":")
    if len(pieces) < 3 or pieces[0] != "jdbc":
        raise SpecError("connection needs a JDBC url")
    return pieces[1].lower()


def base_options(options: Mapping[str, Any], guards: Guards | None = None) -> dict[str, str]:
    merged = {"fetchsize": str(FETCH_SIZE), **{k: str(v) for k, v in options.items()}}
    if guards and guards.timeout_s:
        merged.setdefault("queryTimeout", str(guards.timeout_s))
    return merged


#: What a job may say about how its source is read; the connection alone says where and how to log in.
JOB_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions", "fetchsize")


def reader_options(source: JobSource) -> dict[str, Any]:
    """The job's options that are about splitting the read."""
    names = {n.lower(): n for n in JOB_OPTIONS}
    return {names[k.lower()]: v for k, v in source.options.items() if k.lower() in names}


def table_options(
    options: Mapping[str, Any], source: JobSource, guards: Guards | None = None
) -> dict[str, str]:
    """Reader options for a structured extract.

    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` in the
    connection's or the source's options split the read over executors.
    """
    name = check_name(source.table, "table")
    if source.schema:
        name = f"{check_name(source.schema, 'schema')}.{name}"
    merged = base_options({**options, **reader_options(source)}, guards)
    merged.pop("allowed_schemas", None)
    return {**merged, "dbtable": name}


def rendered_mark(value: str | None, kind: str) -> str:
    """A watermark as a SQL literal; without one, NULL."""
    if value is None:
        return "NULL"
    if kind == "integer":
        if not re.fullmatch(r"-?\d+", value.strip()):
            raise SpecError(f"watermark {value!r} is not an integer")
        return value.strip()
    if not re.fullmatch(r"[0-9T:.\-+ Z]+", value):
        raise SpecError(f"watermark {value!r} is not a timestamp")
    plain = value.replace("T", " ").removesuffix("Z").split("+")[0]
    return f"TIMESTAMP '{plain if ':' in plain else plain + ' 00:00:00'}'"


def query_options(
    spark: SparkSession,
    options: Mapping[str, Any],
    source: JobSource,
    watermark: WatermarkSpec | None,
    mark: str | None,
    guards: Guards | None = None,
    bounded: bool = False,
) -> dict[str, str]:
    """Reader options for a raw SELECT with an optional ``:watermark`` marker."""
    text = MARK.sub(lambda _: rendered_mark(mark, watermark.type if watermark else "timestamp"), source.raw_sql or "")
    allowed = options.get("allowed_schemas")
    checked = check_select(spark, text, allowed_schemas=allowed, bounded=bounded)
    merged = base_options({k: v for k, v in options.items() if k != "allowed_schemas"}, guards)
    for key in ("partitionColumn", "lowerBound", "upperBound", "numPartitions"):
        merged.pop(key, None)
    return {**merged, "query": checked.text}


def load(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def lowered(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def legacy_numeric(df: DataFrame) -> DataFrame:
    """Every number as a double, as older landings have them."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.NumericType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def read_jdbc(
    spark: SparkSession,
    options: Mapping[str, Any],
    source: JobSource,
    watermark: WatermarkSpec | None = None,
    mark: str | None = None,
    guards: Guards | None = None,
    loader=load,
) -> DataFrame:
    """Rows after the high-water mark, with the job's columns and filters pushed down."""
    oracle = source.kind == "oracle"
    allowed = options.get("allowed_schemas")
    if source.mode == "raw":
        frame = loader(spark, query_options(spark, options, source, watermark, mark, guards, bounded=oracle))
        return lowered(frame) if oracle else frame
    if allowed is not None and (source.schema or "").lower() not in {s.lower() for s in allowed}:
        raise SpecError(f"schema {source.schema!r} is not allowed")
    frame = loader(spark, table_options(options, source, guards))
    frame = where(frame, source.filters)
    if watermark is not None:
        frame = since(frame, watermark.column, mark, source.options.get("lag"))
    frame = frame.select(*[column_of(frame.schema, c) for c in source.columns])
    return lowered(frame) if oracle else frame


def tables_query(options: Mapping[str, Any]) -> dict[str, str]:
    kind = database_kind(options)
    merged = base_options({k: v for k, v in options.items() if k != "allowed_schemas"})
    return {**merged, "query": TABLE_CATALOGS.get(kind, TABLE_CATALOGS["default"])}


def list_tables(spark: SparkSession, options: Mapping[str, Any], schema: str | None = None, loader=load) -> DataFrame:
    """``table_schema, table_name`` of the database, optionally of one schema."""
    frame = lowered(loader(spark, tables_query(options)))
    if schema:
        frame = frame.filter(F.lower("table_schema") == schema.lower())
    return frame.orderBy("table_schema", "table_name")
