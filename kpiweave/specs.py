"""Declarative contracts: queries, jobs, loads and dashboards.

Plain frozen dataclasses. ``from_json``/``to_json`` use the wire names
(``groupBy``, ``as``, ``schema``, ``duckdb_sql`` ...) so that stored definitions
can be read as they are.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

# Fixed values of the wire format.
FILTER_OPS = ("=", "!=", ">", ">=", "<", "<=", "in", "not_in", "like", "between", "is_null", "is_not_null")
AGGREGATE_NAMES = ("sum", "avg", "min", "max", "count", "count_distinct", "median", "stddev")
LOAD_MODES = ("full", "append", "upsert")
SOURCE_KINDS = ("oracle", "connection", "csv", "duckdb_query", "synthetic")
SOURCE_MODES = ("structured", "raw")
WIDGET_TYPES = ("line", "bar", "area", "pie", "scatter", "kpi", "table", "map")
RETENTION_STRATEGIES = ("keep_forever", "rolling_window")
WATERMARK_TYPES = ("timestamp", "integer")
DEFAULT_LIMIT = 1000
MAX_LIMIT = 100_000
DEFAULT_RETENTION_DAYS = 395

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$#]{0,127}")


class SpecError(ValueError):
    """A definition that cannot be run."""


def check_name(name: Any, what: str = "column") -> str:
    """Return ``name`` if it is a plain identifier, else raise."""
    if isinstance(name, str) and IDENTIFIER.fullmatch(name):
        return name
    raise SpecError(f"{what} name {name!r} is not a plain identifier")


def _one_of(value: Any, allowed: tuple[str, ...], what: str) -> str:
    text = str(value).lower()
    if text not in allowed:
        raise SpecError(f"{what} must be one of {', '.join(allowed)}; got {value!r}")
    return text


def _set(obj: Any, **values: Any) -> None:
    for key, value in values.items():
        object.__setattr__(obj, key, value)


@dataclass(frozen=True)
class Filter:
    col: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        check_name(self.col)
        _set(self, op=_one_of(self.op, FILTER_OPS, "filter op"))
        if self.op == "between":
            if not isinstance(self.value, (list, tuple)) or len(self.value) != 2:
                raise SpecError("between takes exactly two values")
        if self.op in ("in", "not_in"):
            if self.value is not None and not isinstance(self.value, (list, tuple, set, frozenset)):
                raise SpecError(f"{self.op} takes a list of values")

    @classmethod
    def from_json(cls, data: Mapping[str, Any]) -> Filter:
        return cls(data["col"], data["op"], data.get("value"))

    def to_json(self) -> dict[str, Any]:
        return {"col": self.col, "op": self.op, "value": self.value}


@dataclass(frozen=True)
class Aggregation:
    fn: str
    col: str | None
    alias: str

    def __post_init__(self) -> None:
        _set(self, fn=_one_of(self.fn, AGGREGATE_NAMES, "aggregation"))
        check_name(self.alias, "output")
        if self.col is not None:
            check_name(self.col)
        elif self.fn != "count":
            raise SpecError(f"{self.fn} needs a column")

    @classmethod
    def from_json(cls, data: Mapping[str, Any]) -> Aggregation:
        return cls(data["fn"], data.get("col"), data["as"])

    def to_json(self) -> dict[str, Any]:
        return {"fn": self.fn, "col": self.col, "as": self.alias}


@dataclass(frozen=True)
class Sort:
    col: str
    dir: str = "asc"

    def __post_init__(self) -> None:
        check_name(self.col)
        _set(self, dir=_one_of(self.dir, ("asc", "desc"), "sort direction"))

    @classmethod
    def from_json(cls, data: Mapping[str, Any]) -> Sort:
        return cls(data["col"], data.get("dir", "asc"))

    def to_json(self) -> dict[str, Any]:
        return {"col": self.col, "dir": self.dir}


@dataclass(frozen=True)
class QuerySpec:
    table: str
    columns: tuple[str, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()
    group_by: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    sort: tuple[Sort, ...] = ()
    limit: int = DEFAULT_LIMIT
    page: int = 1
    table_version_pin: int | None = None
    include_sql: bool = False

    def __post_init__(self) -> None:
        for key in ("columns", "aggregations", "group_by", "filters", "sort"):
            _set(self, **{key: tuple(getattr(self, key) or ())})
        check_name(self.table, "table")
        for name in (*self.columns, *self.group_by):
            check_name(name)
        if not 1 <= int(self.limit) <= MAX_LIMIT:
            raise SpecError(f"limit must be between 1 and {MAX_LIMIT}")
        if int(self.page) < 1:
            raise SpecError("page starts at 1")
        if self.table_version_pin is not None and self.table_version_pin < 1:
            raise SpecError("table_version_pin starts at 1")
        if self.aggregations:
            outputs = [*self.group_by, *(a.alias for a in self.aggregations)]
        else:
            outputs = list(self.columns)
        lowered = [name.lower() for name in outputs]
        twice = sorted({name for name in lowered if lowered.count(name) > 1})
        if twice:
            raise SpecError(f"output names used twice: {', '.join(twice)}")

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.limit

    @classmethod
    def from_json(cls, data: Mapping[str, Any]) -> QuerySpec:
        return cls(
            table=data["table"],
            columns=tuple(data.get("columns") or ()),
            aggregations=tuple(map(Aggregation.from_json, data.get("aggregations") or ())),
            group_by=tuple(data.get("groupBy") or data.get("group_by") or ()),
            filters=tuple(map(Filter.from_json, data.get("filters") or ())),
            sort=tuple(map(Sort.from_json, data.get("sort") or ())),
            limit=data.get("limit", DEFAULT_LIMIT),
            page=data.get("page", 1),
            table_version_pin=data.get("table_version_pin"),
            include_sql=bool(data.get("include_sql", False)),
        )

    def to_json(self) -> dict[str, Any]:
        return {
            "table": self.table,
            "columns": list(self.columns),
            "aggregations": [a.to_json() for a in self.aggregations],
            "groupBy": list(self.group_by),
            "filters": [f.to_json() for f in self.filters],
            "sort": [s.to_json() for s in self.sort],
            "limit": self.limit,
            "page": self.page,
            "table_version_pin": self.table_version_pin,
            "include_sql": self.include_sql,
        }


@dataclass(frozen=True)
class JobSource:
    kind: str = "oracle"
    schema: str | None = None
    table: str | None = None
    mode: str = "structured"
    columns: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    raw_sql: str | None = None
    connection_id: int | str | None = None
    upload_id: str | None = None
    transform_sql: str | None = None
    # Extra reader options: CSV dialect, JDBC partitioning, synthetic grid size.
    options: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _set(
            self,
            kind=_one_of(self.kind, SOURCE_KINDS, "source kind"),
            mode=_one_of(self.mode, SOURCE_MODES, "source mode"),
            columns=tuple(self.columns or ()),
            filters=tuple(self.filters or ()),
        )
        needs: list[tuple[bool, str]] = []
        if self.kind in ("oracle", "connection"):
            if self.kind == "connection":
                needs.append((self.connection_id is not None, "a connection_id"))
            if self.mode == "raw":
                needs.append((bool(self.raw_sql), "raw_sql in raw mode"))
            else:
                needs.append((bool(self.table and self.columns), "a table and columns"))
        if self.kind == "csv":
            needs.append((bool(self.upload_id), "an upload_id"))
        if self.kind == "duckdb_query":
            needs.append((bool(self.transform_sql), "a SELECT"))
        for met, what in needs:
            if not met:
                raise SpecError(f"{self.kind} source needs {what}")

    @property
    def is_rdbms(self) -> bool:
        return self.kind in ("oracle", "connection")

    @classmethod
    def from_json(cls, data: Mapping[str, Any]) -> JobSource:
        return cls(
            kind=data.get("kind", "oracle"),
            schema=data.get("schema"),
            table=data.get("table"),
            mode=data.get("mode", "structured"),
            columns=tuple(data.get("columns") or ()),
            filters=tuple(map(Filter.from_json, data.get("filters") or ())),
            raw_sql=data.get("raw_sql"),
            connection_id=data.get("connection_id"),
            upload_id=data.get("upload_id"),
            transform_sql=data.get("duckdb_sql"),
            options=dict(data.get("options") or {}),
        )

    def to_json(self) -> dict[str, Any]:
        return {
            "kind": self.kind,
            "schema": self.schema,
            "table": self.table,
            "mode": self.mode,
            "columns": list(self.columns),
            "filters": [f.to_json() for f in self.filters],
            "raw_sql": self.raw_sql,
            "connection_id": self.connection_id,
            "upload_id": self.upload_id,
            "duckdb_sql": self.transform_sql,
            "options": dict(self.options),
        }


@dataclass(frozen=True)
class Schedule:
    every: str | None = None
    cron: str | None = None
    timezone: str = "UTC"

    def __post_init__(self) -> None:
        if not (self.every or self.cron):
            raise SpecError("schedule needs 'every' or 'cron'")


@dataclass(frozen=True)
class WatermarkSpec:
    column: str
    type: str = "timestamp"

    def __post_init__(self) -> None:
        check_name(self.column)
        _set(self, type=_one_of(self.type, WATERMARK_TYPES, "watermark type"))


@dataclass(frozen=True)
class Retention:
    strategy: str = "rolling_window"
    window_days: int | None = DEFAULT_RETENTION_DAYS

    def __post_init__(self) -> None:
        _set(self, strategy=_one_of(self.strategy, RETENTION_STRATEGIES, "retention strategy"))


@dataclass(frozen=True)
class Guards:
    """Limits of one extract; none unless given."""

    row_cap: int | None = None
    timeout_s: int | None = None


@dataclass(frozen=True)
class JobSpec:
    name: str
    source: JobSource
    target_table: str
    schedule: Schedule
    load_mode: str = "upsert"
    watermark: WatermarkSpec | None = None
    key_columns: tuple[str, ...] = ()
    retention: Retention = field(default_factory=Retention)
    guards: Guards = field(default_factory=Guards)
    is_enabled: bool = True

    def __post_init__(self) -> None:
        _set(
            self,
            load_mode=_one_of(self.load_mode, LOAD_MODES, "load mode"),
            key_columns=tuple(self.key_columns or ()),
        )
        check_name(self.target_table, "table")
        for key in self.key_columns:
            check_name(key)
        if self.load_mode == "upsert" and not self.key_columns:
            raise SpecError("upsert needs key_columns")
        if self.source.is_rdbms and self.load_mode != "full" and self.watermark is None:
            raise SpecError(f"{self.load_mode} from a database needs a watermark")

    @classmethod
    def from_json(cls, data: Mapping[str, Any]) -> JobSpec:
        mark = data.get("watermark")
        return cls(
            name=data["name"],
            source=JobSource.from_json(data["source"]),
            target_table=data["target_table"],
            schedule=Schedule(**data["schedule"]),
            load_mode=data.get("load_mode", "upsert"),
            watermark=WatermarkSpec(**mark) if mark else None,
            key_columns=tuple(data.get("key_columns") or ()),
            retention=Retention(**(data.get("retention") or {})),
            guards=Guards(**(data.get("guards") or {})),
            is_enabled=data.get("is_enabled", True),
        )

    def to_json(self) -> dict[str, Any]:
        return {
            "name": self.name,
            "source": self.source.to_json(),
            "target_table": self.target_table,
            "schedule": vars(self.schedule).copy(),
            "load_mode": self.load_mode,
            "watermark": vars(self.watermark).copy() if self.watermark else None,
            "key_columns": list(self.key_columns),
            "retention": vars(self.retention).copy(),
            "guards": vars(self.guards).copy(),
            "is_enabled": self.is_enabled,
        }


@dataclass(frozen=True)
class LoadCommand:
    """One load: a landed Parquet directory or a SELECT, applied to a table."""

    run_id: str
    table: str
    load_mode: str
    landing_path: str | None = None
    transform_sql: str | None = None
    key_columns: tuple[str, ...] = ()
    watermark: WatermarkSpec | None = None
    watermark_value: str | None = None
    rows_read: int = 0
    job_name: str | None = None

    def __post_init__(self) -> None:
        check_name(self.table, "table")
        _set(
            self,
            load_mode=_one_of(self.load_mode, LOAD_MODES, "load mode"),
            key_columns=tuple(self.key_columns or ()),
        )
        if bool(self.landing_path) == bool(self.transform_sql):
            raise SpecError("a load takes either landing_path or a SELECT")
        if self.load_mode == "upsert" and not self.key_columns:
            raise SpecError("upsert needs key_columns")

    @classmethod
    def from_json(cls, data: Mapping[str, Any]) -> LoadCommand:
        mark = data.get("watermark")
        return cls(
            run_id=data["run_id"],
            table=data["table"],
            load_mode=data["load_mode"],
            landing_path=data.get("landing_path"),
            transform_sql=data.get("duckdb_sql"),
            key_columns=tuple(data.get("key_columns") or ()),
            watermark=WatermarkSpec(**mark) if mark else None,
            watermark_value=data.get("watermark_value"),
            rows_read=data.get("rows_read", 0),
            job_name=data.get("job_name"),
        )

    def to_json(self) -> dict[str, Any]:
        return {
            "run_id": self.run_id,
            "table": self.table,
            "load_mode": self.load_mode,
            "landing_path": self.landing_path,
            "duckdb_sql": self.transform_sql,
            "key_columns": list(self.key_columns),
            "watermark": vars(self.watermark).copy() if self.watermark else None,
            "watermark_value": self.watermark_value,
            "rows_read": self.rows_read,
            "job_name": self.job_name,
        }


@dataclass(frozen=True)
class Widget:
    id: str
    type: str
    query: QuerySpec
    title: str = ""
    viz: Mapping[str, Any] = field(default_factory=dict)
    grid: Mapping[str, int] = field(default_factory=lambda: {"x": 0, "y": 0, "w": 6, "h": 6})

    def __post_init__(self) -> None:
        _set(self, type=_one_of(self.type, WIDGET_TYPES, "widget type"))

    @classmethod
    def from_json(cls, data: Mapping[str, Any]) -> Widget:
        source = data["source"]
        query = complete_query({**(data.get("query") or {}), "table": source["table"]})
        pin = source.get("table_version_pin")
        if pin is not None and query.get("table_version_pin") is None:
            query["table_version_pin"] = pin
        grid = {"x": 0, "y": 0, "w": 6, "h": 6, **(data.get("grid") or {})}
        return cls(
            id=data["id"],
            type=data["type"],
            query=QuerySpec.from_json(query),
            title=data.get("title", ""),
            viz=dict(data.get("viz") or {}),
            grid=grid,
        )

    def to_json(self) -> dict[str, Any]:
        source = {"table": self.query.table, "table_version_pin": self.query.table_version_pin}
        return {
            "id": self.id,
            "type": self.type,
            "title": self.title,
            "source": source,
            "query": self.query.to_json(),
            "viz": dict(self.viz),
            "grid": dict(self.grid),
        }


@dataclass(frozen=True)
class Dashboard:
    widgets: tuple[Widget, ...] = ()
    version: int = 1
    layout: Mapping[str, int] = field(default_factory=lambda: {"cols": 12, "rowHeight": 40})

    def __post_init__(self) -> None:
        _set(self, widgets=tuple(self.widgets))
        ids = [w.id for w in self.widgets]
        if len(set(ids)) != len(ids):
            raise SpecError("widget ids must be unique")

    @classmethod
    def from_json(cls, data: Mapping[str, Any]) -> Dashboard:
        return cls(
            widgets=tuple(map(Widget.from_json, data.get("widgets") or ())),
            version=data.get("version", 1),
            layout={"cols": 12, "rowHeight": 40, **(data.get("layout") or {})},
        )

    def to_json(self) -> dict[str, Any]:
        return {
            "version": self.version,
            "layout": dict(self.layout),
            "widgets": [w.to_json() for w in self.widgets],
        }


def complete_query(query: Mapping[str, Any]) -> dict[str, Any]:
    """Drop half-filled editor state: unfinished aggregations and empty sorts."""

    def finished(agg: Mapping[str, Any]) -> bool:
        named = bool(agg.get("fn")) and bool(agg.get("as"))
        return named and (bool(agg.get("col")) or agg["fn"] == "count")

    cleaned = dict(query)
    cleaned["aggregations"] = [a for a in query.get("aggregations") or () if a and finished(a)]
    cleaned["sort"] = [s for s in query.get("sort") or () if s and s.get("col")]
    return cleaned
