"""The given tables in the roles of a KPI platform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.operators.query import unpaged
from kpiweave.plans.store import TableStore
from kpiweave.session import scratch_path
from kpiweave.specs import QuerySpec


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; its schema is looked up once."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def kpi_feed(spark: SparkSession, folder: str) -> DataFrame:
    """events as a KPI feed: hour, cell, region, traffic; drops only where they happen."""
    error = F.col("event_type") == "error"
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts"),
        F.col("user_id").alias("cell_id"),
        F.col("event_type").alias("region"),
        F.col("value").alias("traffic"),
        F.when(error, F.col("value")).alias("drops"),
        F.when(error, F.col("user_id")).alias("failing_cell"),
    )


KPI_SQL = """(SELECT event_id, ts, date_trunc('hour', ts) AS hour_ts, user_id AS cell_id,
    event_type AS region, value AS traffic,
    CASE WHEN event_type = 'error' THEN value END AS drops,
    CASE WHEN event_type = 'error' THEN user_id END AS failing_cell
  FROM events)"""


def whole(df: DataFrame, **query) -> DataFrame:
    """All rows a structured query stands for, without its page."""
    return unpaged(df, QuerySpec.from_json({"table": "t", **query}))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; compare without those."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


def as_bigint(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in names else F.col(c) for c in df.columns])


def new_store(spark: SparkSession, label: str) -> TableStore:
    return TableStore(spark, scratch_path(spark, label))
