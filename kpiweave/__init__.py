"""Materialised KPI tables on Spark: land, load, query, shape and watch them."""

from kpiweave.specs import (
    Aggregation,
    Dashboard,
    Filter,
    Guards,
    JobSource,
    JobSpec,
    LoadCommand,
    QuerySpec,
    Retention,
    Schedule,
    Sort,
    SpecError,
    WatermarkSpec,
    Widget,
)

__all__ = [
    "Aggregation",
    "Dashboard",
    "Filter",
    "Guards",
    "JobSource",
    "JobSpec",
    "LoadCommand",
    "QuerySpec",
    "Retention",
    "Schedule",
    "Sort",
    "SpecError",
    "WatermarkSpec",
    "Widget",
]
