"""Versioned tables: Parquet segments plus one small manifest per version.

    {root}/registry/{table}/{version}.json   what a version consists of (written last)
    {root}/data/{table}/_run=.../[_day=..]/[_bucket=..]/   segments
    {root}/landing/{table}/_run=.../         one Parquet directory per run (replay log)
    {root}/runs/{table}/                     run records

A reader holds a version, so loads never block or change a running query. A load that
dies leaves only unreferenced files behind.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.functions.aggregates import is_clock
from kpiweave.functions.predicates import field_of, literal
from kpiweave.functions.timing import interval_seconds, is_stale
from kpiweave.operators.query import apply_query, count_total, query_text
from kpiweave.plans.files import Files
from kpiweave.specs import Filter, QuerySpec, SpecError, check_name

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # fixed name in partitioned datasets


class TableNotFound(LookupError):
    """No committed version under that name."""


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def _moment(value: str | datetime | None) -> datetime | None:
    """A stored or given time without its zone, in UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return value.astimezone(UTC).replace(tzinfo=None) if value is not None and value.tzinfo else value


def iso(moment: datetime | None) -> str | None:
    return moment.isoformat(sep=" ") if moment is not None else None


def new_run_id() -> str:
    """Sortable by start time."""
    return f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"


def utc_day(column: Column, kind: T.DataType) -> Column:
    """The day a row is filed under; the same whatever zone a session has."""
    if not isinstance(kind, T.TimestampType):
        return F.to_date(column)
    days = F.floor(F.unix_micros(column) / F.lit(86_400_000_000)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


@dataclass(frozen=True)
class Layout:
    """How a table's rows are spread: by day of a time column, by key hash, or both.

    A row's place must not change between upserts, so a keyed table may only use a day
    column that is one of its keys.
    """

    day: str | None = None
    buckets: int = 0
    keys: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [name for name, used in (("_day", self.day), ("_bucket", self.buckets)) if used]

    def fields(self) -> list[T.StructField]:
        kinds = {"_day": T.DateType(), "_bucket": T.IntegerType()}
        return [T.StructField(name, kinds[name], True) for name in self.columns]

    def place(self, df: DataFrame) -> DataFrame:
        if self.day:
            df = df.withColumn("_day", utc_day(F.col(f"`{self.day}`"), df.schema[self.day].dataType))
        if self.buckets:
            df = df.withColumn("_bucket", self.bucket_of(*[F.col(f"`{k}`") for k in self.keys]))
        return df

    def bucket_of(self, *keys):
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def serves(self, keys: Iterable[str]) -> bool:
        """Whether rows with equal keys always share a place."""
        given = {k.lower() for k in keys}
        by_keys = not self.buckets or {k.lower() for k in self.keys} == given
        return by_keys and (self.day is None or self.day.lower() in given)


@dataclass(frozen=True)
class Part:
    """One directory of rows; ``place`` holds its layout values as text (or None)."""

    path: str
    rows: int
    place: tuple[str | None, ...] = ()


@dataclass(frozen=True)
class Manifest:
    table: str
    version: int
    run_id: str
    load_mode: str
    schema: str
    parts: tuple[Part, ...]
    row_count: int
    rows_written: int
    layout: Layout = field(default_factory=Layout)
    key_columns: tuple[str, ...] = ()
    watermark_column: str | None = None
    watermark_value: str | None = None
    source_job: str | None = None
    landing_path: str | None = None
    applied_runs: tuple[str, ...] = ()
    inputs: dict[str, int] = field(default_factory=dict)
    started_at: str | None = None
    committed_at: str | None = None
    note: str | None = None

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    def to_text(self) -> str:
        return json.dumps(asdict(self), default=str)

    @classmethod
    def from_text(cls, text: str) -> Manifest:
        data = json.loads(text)
        data["layout"] = Layout(**{**data["layout"], "keys": tuple(data["layout"]["keys"])})
        data["parts"] = tuple(
            Part(p["path"], p["rows"], tuple(p["place"])) for p in data["parts"]
        )
        for name in ("key_columns", "applied_runs"):
            data[name] = tuple(data[name])
        return cls(**data)


@dataclass(frozen=True)
class QueryResult:
    """A page of rows with its version and freshness labels."""

    rows: DataFrame
    page: int
    table_version: int
    data_as_of: str | None
    total: int | None = None
    sql: str | None = None
    stale: bool | None = None


class TableStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.files = Files(spark)

    # --- names ---------------------------------------------------------------
    def registry_dir(self, table: str) -> str:
        return f"{self.root}/registry/{check_name(table, 'table')}"

    def data_dir(self, table: str) -> str:
        return f"{self.root}/data/{check_name(table, 'table')}"

    def landing_dir(self, table: str) -> str:
        return f"{self.root}/landing/{check_name(table, 'table')}"

    def landing_path(self, table: str, run_id: str) -> str:
        return f"{self.landing_dir(table)}/_run={run_id}"

    # --- versions ------------------------------------------------------------
    def tables(self) -> list[str]:
        """Readable tables by name; one without a committed version is not readable."""
        names = [name for name, _ in self.files.children(f"{self.root}/registry")]
        return [name for name in names if self.versions(name)]

    def versions(self, table: str) -> list[int]:
        entries = self.files.children(self.registry_dir(table))
        return [int(name.removesuffix(".json")) for name, _ in entries if name.endswith(".json")]

    def manifest(self, table: str, version: int | None = None) -> Manifest:
        known = self.versions(table)
        if not known or (version is not None and version not in known):
            wanted = "" if version is None else f" version {version}"
            raise TableNotFound(f"unknown table {table!r}{wanted}")
        return self._read_manifest(table, version or known[-1])

    def head(self, table: str) -> Manifest | None:
        known = self.versions(table)
        return self._read_manifest(table, known[-1]) if known else None

    def history(self, table: str) -> list[Manifest]:
        return [self._read_manifest(table, v) for v in self.versions(table)]

    def _read_manifest(self, table: str, version: int) -> Manifest:
        return Manifest.from_text(self.files.read(f"{self.registry_dir(table)}/{version:010d}.json"))

    def commit(self, manifest: Manifest) -> Manifest:
        path = f"{self.registry_dir(manifest.table)}/{manifest.version:010d}.json"
        if not self.files.create(path, manifest.to_text()):
            raise CommitConflict(f"{manifest.table} version {manifest.version} exists")
        return manifest

    # --- reading -------------------------------------------------------------
    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table version as a DataFrame."""
        manifest = self.manifest(table, version)
        return self.rows_of(manifest).select(*[F.col(f"`{n}`") for n in manifest.struct.names])

    def rows_of(self, manifest: Manifest, parts: Iterable[Part] | None = None) -> DataFrame:
        """Rows of the given parts with their layout columns, for partition pruning."""
        chosen = list(manifest.parts if parts is None else parts)
        fields = [*manifest.struct.fields, *manifest.layout.fields()]
        schema = T.StructType(fields)
        if not chosen:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if manifest.layout.columns:
            reader = reader.option("basePath", self.data_dir(manifest.table))
        return reader.parquet(*[f"{self.root}/{p.path}" for p in chosen])

    def sample(self, table: str, n: int = 20) -> DataFrame:
        return self.read(table).limit(n)

    def query(
        self,
        spec: QuerySpec,
        tie_break: tuple[str, ...] = (),
        with_total: bool = False,
        every: str | None = None,
        as_of: datetime | None = None,
    ) -> QueryResult:
        """Run a structured query against the pinned or the latest version.

        ``with_total`` runs one count over the filtered rows, for the first page of an
        unaggregated query. ``every``: the interval of the job that feeds the table (an hour if
        unknown); with it the answer tells whether the data are older than they should be.
        """
        manifest = self.manifest(spec.table, spec.table_version_pin)
        rows = self.rows_of(manifest)
        rows = rows.filter(prune) if (prune := layout_filter(manifest, spec.filters)) is not None else rows
        names = manifest.struct.names
        visible = rows.select(*[F.col(f"`{n}`") for n in names])
        total = None
        if with_total and spec.page == 1 and not spec.aggregations:
            total = count_total(visible, spec.filters).first()["n"]
        return QueryResult(
            rows=apply_query(visible, spec, tie_break),
            page=spec.page,
            table_version=manifest.version,
            data_as_of=manifest.committed_at,
            total=total,
            sql=query_text(spec)[0] if spec.include_sql else None,
            stale=is_stale(_moment(manifest.committed_at), interval_seconds(every), _moment(as_of) or utc_now()),
        )

    # --- segments ------------------------------------------------------------
    def write_segment(self, table: str, run_id: str, rows: DataFrame, layout: Layout) -> list[Part]:
        """Write rows as a new segment and return its parts with their row counts."""
        relative = f"data/{table}/_run={run_id}-{uuid.uuid4().hex[:8]}"
        target = f"{self.root}/{relative}"
        struct = rows.schema
        if not layout.columns:
            seen = Observation()
            rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(target)
            count = seen.get["rows"]
            return [Part(relative, count)] if count else []
        # REBALANCE lets AQE split a hot day or bucket over tasks and merge small ones.
        placed = layout.place(rows).hint("rebalance", *layout.columns)
        placed.write.partitionBy(*layout.columns).parquet(target)
        read_schema = T.StructType([*struct.fields, *layout.fields()])
        # No data column is read: the counts come from the Parquet footers, and the
        # rows returned are one per written partition.
        counted = self.spark.read.schema(read_schema).parquet(target).groupBy(*layout.columns).count()
        parts = []
        for row in counted.collect():
            place = tuple(None if row[c] is None else str(row[c]) for c in layout.columns)
            names = [f"{c}={NULL_PARTITION if v is None else v}" for c, v in zip(layout.columns, place, strict=True)]
            parts.append(Part("/".join([relative, *names]), row["count"], place))
        return sorted(parts, key=lambda p: p.path)


def layout_filter(manifest: Manifest, filters: Iterable[Filter]):
    """Partition predicates implied by the query's filters, or None.

    A range on the day column bounds ``_day``; equality on every key fixes ``_bucket``.
    """
    layout, schema = manifest.layout, manifest.struct
    terms = []
    equal: dict[str, Any] = {}
    for item in filters:
        name = field_of(schema, item.col).name
        if item.op == "=" and item.value is not None:
            equal[name] = item.value
        if layout.day is None or name != layout.day:
            continue
        terms += _day_terms(field_of(schema, name).dataType, item)
    if layout.buckets and layout.keys and set(layout.keys) <= set(equal):
        typed = [literal(equal[k], field_of(schema, k).dataType).cast(field_of(schema, k).dataType) for k in layout.keys]
        terms.append(F.col("_bucket") == layout.bucket_of(*typed))
    if not terms:
        return None
    combined = terms[0]
    for term in terms[1:]:
        combined = combined & term
    return combined


def _day_terms(kind: T.DataType, item: Filter) -> list:
    def day(value: Any):
        return utc_day(literal(value, kind).cast(kind), kind)

    column = F.col("_day")
    if item.op == "is_null":
        return [column.isNull()]
    if item.op == "between":
        return [column >= day(item.value[0]), column <= day(item.value[1])]
    if item.op == "in" and item.value:
        return [column.isin(*[day(v) for v in item.value])]
    if item.op == "=":
        return [column == day(item.value)]
    if item.op in (">", ">="):
        return [column >= day(item.value)]
    if item.op in ("<", "<="):
        return [column <= day(item.value)]
    return []


def choose_layout(
    schema: T.StructType,
    load_mode: str,
    keys: tuple[str, ...],
    watermark_column: str | None,
    batch_bytes: int,
    bucket_bytes: int = 512 * 1024 * 1024,
) -> Layout:
    """Layout of a new table, from its declared keys and watermark.

    Time-ordered deltas touch few days, so a time watermark wins where rows cannot move
    between days; other keyed tables are spread by key hash over about 512 MB buckets.
    """
    mark = field_of(schema, watermark_column) if watermark_column else None
    names = tuple(field_of(schema, k).name for k in keys)
    by_day = mark is not None and is_clock(mark.dataType) and (load_mode != "upsert" or mark.name in names)
    if by_day:
        return Layout(day=mark.name, keys=names)
    if load_mode == "upsert":
        buckets = min(4096, -(-batch_bytes // bucket_bytes))
        if buckets > 1:
            return Layout(buckets=buckets, keys=names)
    return Layout(keys=names)


def day_value(text: str | None) -> date | None:
    return None if text is None else date.fromisoformat(text)
