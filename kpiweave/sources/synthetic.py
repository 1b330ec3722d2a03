"""Deterministic hourly KPI rows per cell, for demos and tests without a database."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the generator: regions in cell order, metric means, spreads, floors, digits.
REGIONS = ("North", "South", "East", "West")
CELLS = 12
WINDOW_HOURS = 48
TRAFFIC_MEAN = {"North": 42.0, "South": 31.0, "East": 26.0, "West": 37.0}
THROUGHPUT_MEAN = {"North": 135.0, "South": 90.0, "East": 70.0, "West": 110.0}


def _hour(moment: datetime) -> datetime:
    return moment.replace(minute=0, second=0, microsecond=0, tzinfo=None)


def hour_range(as_of: datetime, watermark: str | None = None) -> tuple[datetime, int]:
    """First hour and number of hours: the full window, or all hours after the mark."""
    last = _hour(as_of)
    first = last - timedelta(hours=WINDOW_HOURS)
    if watermark:
        try:
            first = _hour(datetime.fromisoformat(watermark)) + timedelta(hours=1)
        except ValueError:
            first += timedelta(hours=1)
    return first, max(0, int((last - first) / timedelta(hours=1)) + 1)


def _uniform(*parts: Column) -> Column:
    """In (0, 1], the same for the same parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))


def _normal(name: str, mean: Column, spread: Column) -> Column:
    seed = (F.lit(name), F.col("cell_id"), F.col("timestamp"))
    radius = F.sqrt(-2 * F.ln(_uniform(F.lit("r"), *seed)))
    return mean + spread * radius * F.cos(2 * F.pi() * _uniform(F.lit("a"), *seed))


def _by_region(means: dict[str, float]) -> Column:
    column = F.lit(None).cast("double")
    for region, mean in means.items():
        column = F.when(F.col("region") == region, F.lit(mean)).otherwise(column)
    return column


def _metric(name: str) -> Column:
    if name == "traffic_erl":
        mean = _by_region(TRAFFIC_MEAN)
        return F.round(F.greatest(F.lit(0.0), _normal(name, mean, mean * 0.2)), 3)
    if name == "drop_rate":
        return F.round(F.greatest(F.lit(0.0), _normal(name, F.lit(0.8), F.lit(0.4))), 4)
    if name == "throughput_mbps":
        mean = _by_region(THROUGHPUT_MEAN)
        return F.round(F.greatest(F.lit(0.0), _normal(name, mean, mean * 0.25)), 2)
    if name == "latency_ms":
        return F.round(F.greatest(F.lit(1.0), _normal(name, F.lit(35.0), F.lit(10.0))), 2)
    value = F.round(100 * _uniform(F.lit(name), F.col("cell_id"), F.col("timestamp")), 3)
    return value.cast("string") if name.endswith("_id") or name == "name" else value


def metrics_on(grid: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The asked columns for a grid of ``timestamp, cell_id, region``; timestamp always."""
    given = ("timestamp", "cell_id", "region")
    wanted = list(columns) if "timestamp" in columns else ["timestamp", *columns]
    return grid.select(*[F.col(c) if c in given else _metric(c).alias(c) for c in wanted])


def kpi_grid(spark: SparkSession, first: datetime, hours: int, cells: int = CELLS) -> DataFrame:
    """One row per hour and cell, oldest hour first, made by the executors."""
    number = F.col("id")
    start = F.lit(first.isoformat(sep=" ")).cast("timestamp_ntz")
    cell = number % cells
    region = F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (cell % len(REGIONS) + 1).cast("int"))
    return spark.range(hours * cells).select(
        (start + F.make_dt_interval(hours=F.floor(number / cells).cast("int"))).alias("timestamp"),
        F.format_string("CELL_%04d", cell).alias("cell_id"),
        region.alias("region"),
    )


def read_synthetic(
    spark: SparkSession,
    columns: Sequence[str],
    as_of: datetime,
    watermark: str | None = None,
    cells: int = CELLS,
) -> DataFrame:
    first, hours = hour_range(as_of, watermark)
    return metrics_on(kpi_grid(spark, first, hours, cells), columns)
