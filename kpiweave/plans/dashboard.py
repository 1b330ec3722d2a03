"""Dashboards: each widget is one structured query, shaped for its kind of chart."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiweave.functions.predicates import column_of
from kpiweave.plans.store import QueryResult, TableStore
from kpiweave.specs import Dashboard, Filter, QuerySpec, Widget

TABLE_ROWS = 200  # rows a table widget shows
NULL_SERIES = "null"  # name of the series of rows without one


def effective_viz(widget: Widget) -> dict[str, Any]:
    """Visual mapping; what is not given follows from the query."""
    query, given = widget.query, widget.viz
    measure = query.aggregations[0].alias if query.aggregations else None
    columns = list(query.columns)
    first = [*query.group_by, *columns][:1]
    fallback_y = columns[1] if len(columns) > 1 else None
    mapping = dict(given)
    mapping["value"] = given.get("value") or measure or "value"
    mapping["x"] = given.get("x") or (first[0] if first else None)
    mapping["y"] = given.get("y") or measure or fallback_y
    if given.get("series") is not None:
        mapping["series"] = given["series"]
    else:
        mapping["series"] = query.group_by[1] if len(query.group_by) > 1 else None
    return mapping


def pivot_series(rows: DataFrame, x: str, series: str, y: str, names: Sequence[str] | None = None) -> DataFrame:
    """One row per ``x`` with a column per series; a repeated (x, series) keeps its last row.

    Rows and series stand in the order in which the widget's rows first name them. ``names``
    fixes the series columns; without it the distinct names of the widget rows are read first.
    """
    label = F.coalesce(F.col(f"`{series}`").cast("string"), F.lit(NULL_SERIES))
    numbered = rows.select(
        F.col(f"`{x}`"), label.alias("__series"), F.col(f"`{y}`").alias("__y"), F.monotonically_increasing_id().alias("__at")
    )
    if not names:
        met = numbered.groupBy("__series").agg(F.min("__at").alias("__first")).orderBy("__first")
        names = [r["__series"] for r in met.collect()]  # one row a series
    last = [F.max_by("__y", F.when(F.col("__series") == name, F.col("__at"))).alias(name) for name in names]
    pivoted = numbered.groupBy(F.col(f"`{x}`")).agg(F.min("__at").alias("__first"), *last)
    return pivoted.orderBy("__first").drop("__first")


def shape(widget: Widget, rows: DataFrame, series_names: Sequence[str] | None = None) -> DataFrame:
    """The widget's query result as its chart takes it."""
    viz = effective_viz(widget)
    if widget.type == "kpi":
        value = column_of(rows.schema, viz["value"])
        numeric = value.try_cast("double")
        shown = F.when(numeric.isNotNull() & ~F.isnan(numeric), numeric)
        return rows.limit(1).select(shown.alias("value"))
    if widget.type == "table":
        return rows.limit(TABLE_ROWS)
    if widget.type == "map":
        return map_points(rows, viz)
    if widget.type in ("line", "area") and viz["series"]:
        return pivot_series(rows, viz["x"], viz["series"], viz["y"], series_names)
    return rows.select(column_of(rows.schema, viz["x"]), column_of(rows.schema, viz["y"]))


def kpi_text(value: float | None, precision: int = 2) -> str:
    """The number as a KPI tile shows it; a dash when there is none."""
    if value is None or value != value:
        return "—"
    text = f"{value:,.{precision}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def shares(rows: DataFrame, y: str, alias: str = "share") -> DataFrame:
    """Each row's part of the total, for pies; a widget's rows are already few."""
    total = rows.agg(F.sum(F.col(f"`{y}`")).alias("__total"))
    one = F.lit(1).alias("__one")
    joined = rows.select("*", one).join(total.select("*", one), "__one")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(f"`{y}`") / F.col("__total")).alias(alias))


# --- maps -------------------------------------------------------------------------------


def map_points(rows: DataFrame, viz: Mapping[str, Any]) -> DataFrame:
    """lat, lon, weight and tooltip columns of the rows that have a place."""
    lat, lon = viz.get("lat", "lat"), viz.get("lon", "lon")
    chosen = [lat, lon]
    for name in (viz.get("weight"), *(viz.get("tooltip") or ())):
        if name and name not in chosen:
            chosen.append(name)
    placed = rows.filter(F.col(f"`{lat}`").isNotNull() & F.col(f"`{lon}`").isNotNull())
    return placed.select(*[F.col(f"`{c}`") for c in chosen])


def map_cells(
    rows: DataFrame,
    lat: str,
    lon: str,
    size: float,
    weight: str | None = None,
    box: tuple[float, float, float, float] | None = None,
    points: str | None = None,
) -> DataFrame:
    """Rows per grid cell of ``size`` degrees, with the summed weight.

    ``box`` is (south, west, north, east), borders included. Where rows are totals of
    many, ``points`` names the column with their number.
    """
    if box:
        south, west, north, east = box
        rows = rows.filter(F.col(lat).between(south, north) & F.col(lon).between(west, east))
    cell = [F.floor(F.col(c) / F.lit(size)).cast("bigint").alias(f"{c}_cell") for c in (lat, lon)]
    measures = [(F.sum(points) if points else F.count(F.lit(1))).alias("points")]
    if weight:
        measures.append(F.sum(weight).alias("weight"))
    return rows.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*cell).agg(*measures)


def site_totals(facts: DataFrame, key: str, weight: str) -> DataFrame:
    """``points`` and ``weight`` per site.

    Taken before the sites are joined: one row per site then meets the dimension, so
    neither the size of the facts nor one busy site weighs on the join.
    """
    return facts.groupBy(key).agg(F.count(F.lit(1)).alias("points"), F.sum(weight).alias("weight"))


def with_sites(facts: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """KPI rows with their site's columns; facts without a known site stay.

    The site side is left to Spark, which broadcasts it when its measured size allows.
    """
    return facts.join(sites, key, "left")


# --- dashboards --------------------------------------------------------------------------


def cascaded(query: QuerySpec, shared: Iterable[Filter], columns: Iterable[str]) -> QuerySpec:
    """The query with the dashboard's filters on columns its table has."""
    known = {c.lower() for c in columns}
    extra = tuple(f for f in shared if f.col.lower() in known)
    return replace(query, filters=(*query.filters, *extra)) if extra else query


@dataclass(frozen=True)
class WidgetResult:
    widget: Widget
    data: DataFrame
    result: QueryResult


def run_widget(store: TableStore, widget: Widget, shared: Iterable[Filter] = ()) -> WidgetResult:
    manifest = store.manifest(widget.query.table, widget.query.table_version_pin)
    query = cascaded(widget.query, shared, manifest.struct.names)
    result = store.query(replace(query, include_sql=True))
    return WidgetResult(widget, shape(widget, result.rows), result)


def run_dashboard(store: TableStore, board: Dashboard, shared: Iterable[Filter] = ()) -> dict[str, WidgetResult]:
    """Every widget's data by widget id; ``shared`` filters apply wherever they fit."""
    filters = tuple(shared)
    return {w.id: run_widget(store, w, filters) for w in board.widgets}
