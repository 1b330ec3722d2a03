"""Keeping tables healthy: retention, compaction, rebuild, snapshots, expiry."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.functions.aggregates import is_clock
from kpiweave.functions.predicates import column_of, field_of
from kpiweave.operators.merge import replayed
from kpiweave.operators.schemas import aligned
from kpiweave.plans.store import (
    Layout,
    Manifest,
    Part,
    TableStore,
    day_value,
    iso,
    new_run_id,
    utc_now,
)
from kpiweave.specs import Retention, SpecError

ORDINAL = "__at"


def _commit_parts(store: TableStore, head: Manifest, parts: list[Part], mode: str, **changes) -> Manifest:
    return store.commit(
        replace(
            head,
            version=head.version + 1,
            run_id=changes.pop("run_id", new_run_id()),
            load_mode=mode,
            parts=tuple(parts),
            row_count=sum(p.rows for p in parts),
            rows_written=0,
            landing_path=None,
            committed_at=iso(utc_now()),
            **changes,
        )
    )


def _rows(store: TableStore, head: Manifest, parts: list[Part]) -> DataFrame:
    return store.rows_of(head, parts).select(*[F.col(f"`{n}`") for n in head.struct.names])


# --- retention ---------------------------------------------------------------------


def within_window(df: DataFrame, column: str, as_of: datetime, days: int) -> DataFrame:
    """Rows not older than the window; rows without a time are kept."""
    kind = field_of(df.schema, column).dataType
    if not is_clock(kind):
        raise SpecError(f"retention needs a time column; {column} is {kind.simpleString()}")
    cutoff = F.lit(iso(as_of - timedelta(days=days))).cast("timestamp_ntz").cast(kind)
    time = column_of(df.schema, column)
    return df.filter(time.isNull() | (time >= cutoff))


def apply_retention(
    store: TableStore, table: str, retention: Retention, as_of: datetime, column: str | None = None
) -> Manifest:
    """Drop rows older than the rolling window, as a new version.

    In a table laid out by day whole days are dropped from the manifest without touching
    data, and only the day that holds the cutoff is rewritten.
    """
    head = store.manifest(table)
    if retention.strategy == "keep_forever" or retention.window_days is None:
        return head
    column = column or head.watermark_column
    if column is None:
        raise SpecError(f"{table} has no time column to age by")
    cutoff = as_of - timedelta(days=retention.window_days)
    if head.layout.day and head.layout.day.lower() == column.lower():
        at = head.layout.columns.index("_day")
        ages = {p: day_value(p.place[at]) for p in head.parts}
        edge = [p for p, day in ages.items() if day == cutoff.date()]
        kept = [p for p, day in ages.items() if day is None or day > cutoff.date()]
    else:
        edge, kept = list(head.parts), []
    if edge:
        survivors = within_window(_rows(store, head, edge), column, as_of, retention.window_days)
        kept += store.write_segment(table, new_run_id(), survivors, head.layout)
    return _commit_parts(store, head, kept, "retention")


# --- compaction --------------------------------------------------------------------


def compact(store: TableStore, table: str, layout: Layout | None = None, sort_by: tuple[str, ...] = ()) -> Manifest:
    """Merge the segments of each day or bucket; rows stay the same.

    Only places with more than one part are rewritten, unless the layout changes.
    """
    head = store.manifest(table)
    target = layout or head.layout
    if target == head.layout and target.columns:
        seen: dict[tuple, list[Part]] = {}
        for part in head.parts:
            seen.setdefault(part.place, []).append(part)
        crowded = [p for parts in seen.values() if len(parts) > 1 for p in parts]
        kept = [p for p in head.parts if p not in crowded]
    else:
        crowded, kept = list(head.parts), []
        if len(crowded) <= 1 and target == head.layout:
            return head
    if not crowded:
        return head
    rows = _rows(store, head, crowded)
    if not target.columns:
        # No places to gather by: let AQE even out the file sizes.
        rows = rows.repartitionByRange(*[F.col(c) for c in sort_by]) if sort_by else rows.hint("rebalance")
    elif sort_by:
        # Sorted files let a scan skip row groups by the sorted column's statistics.
        rows = rows.sortWithinPartitions(*sort_by)
    written = store.write_segment(table, new_run_id(), rows, target)
    return _commit_parts(store, head, kept + written, "compact", layout=target)


#: Loads after which a version stands for the whole table.
WHOLE_MODES = ("full", "restore", "rebuild")


# --- rebuild from landing -------------------------------------------------------------


def rebuild(store: TableStore, table: str, into: str | None = None) -> Manifest:
    """Load the landed runs again in their order and publish the result.

    From the newest version that stands for the whole table on (a full refresh, a restored
    snapshot, an earlier rebuild): its rows, then every later append and upsert. Where a later
    version or a landed run is missing, nothing is published. Neighbouring loads of one kind are
    taken together.
    """
    history = store.history(table)
    base = max((i for i, m in enumerate(history) if m.load_mode in WHOLE_MODES), default=0)
    whole, later = history[base : base + 1], history[base:]
    versions = [m.version for m in later]
    if not history or (whole[0].load_mode not in WHOLE_MODES and whole[0].version != 1):
        raise LookupError(f"the first versions of {table} are gone; it cannot be rebuilt")
    if versions != list(range(versions[0], versions[0] + len(versions))):
        raise LookupError(f"versions of {table} are missing after {versions[0]}")
    state: DataFrame | None = None
    if not whole[0].landing_path and whole[0].load_mode in WHOLE_MODES:
        state = store.rows_of(whole[0]).select(*[F.col(f"`{n}`") for n in whole[0].struct.names])
    chosen = [m for m in later if m.landing_path]
    gone = [m.landing_path for m in chosen if not store.files.exists(m.landing_path)]
    if gone:
        raise LookupError(f"landed runs of {table} are gone: {', '.join(gone[:5])}")
    if state is None and not chosen:
        raise LookupError(f"{table} has no landed runs")
    newest = later[-1]
    for upsert, keys, group in _stretches(chosen):
        rows = _landed(store, group, newest.struct)
        if upsert:
            if state is not None:
                # Everything before the stretch counts as one earlier run.
                rows = state.withColumn(ORDINAL, F.lit(-1)).unionByName(rows)
            state = replayed(rows, keys, ORDINAL)
        else:
            rows = rows.drop(ORDINAL)
            state = rows if state is None else state.unionByName(rows)
    target = into or table
    head = store.head(target)
    parts = store.write_segment(target, new_run_id(), state, newest.layout)
    return store.commit(
        replace(
            newest,
            table=target,
            version=(head.version if head else 0) + 1,
            run_id=new_run_id(),
            load_mode="rebuild",
            parts=tuple(parts),
            row_count=sum(p.rows for p in parts),
            rows_written=sum(p.rows for p in parts),
            landing_path=None,
            committed_at=iso(utc_now()),
        )
    )


def _stretches(loads: list[Manifest]):
    """Neighbouring loads of one kind and key: (is upsert, keys, loads)."""
    by_kind = groupby(loads, key=lambda m: (m.load_mode == "upsert", m.key_columns if m.load_mode == "upsert" else ()))
    for (upsert, keys), group in by_kind:
        yield upsert, keys, list(group)


def _landed(store: TableStore, loads: list[Manifest], struct: T.StructType) -> DataFrame:
    """Rows of landed runs with the run's place in the load order."""
    order = {m.landing_path.rstrip("/").rpartition("/")[2]: i for i, m in enumerate(loads)}
    # Runs landed with reordered or narrower columns are read apart, the rest in one scan.
    by_schema: dict[str, list[str]] = {}
    for m in loads:
        schema = store.spark.read.parquet(m.landing_path).schema
        by_schema.setdefault(schema.json(), []).append(m.landing_path)
    numbers = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    directory = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    frames = []
    for paths in by_schema.values():
        frame = store.spark.read.parquet(*paths)
        numbered = frame.select("*", F.element_at(numbers, F.url_decode(directory)).alias(ORDINAL))
        frames.append(aligned(numbered, T.StructType([*struct.fields, T.StructField(ORDINAL, T.IntegerType())])))
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


# --- snapshots -------------------------------------------------------------------------


def export_snapshot(store: TableStore, target: str, tables: list[str] | None = None) -> list[str]:
    """Copy every current version with its manifest to a folder."""
    names = tables or store.tables()
    for name in names:
        head = store.manifest(name)
        store.read(name, head.version).write.parquet(f"{target}/{name}/rows")
        store.files.put(f"{target}/{name}/manifest.json", head.to_text())
    return names


def import_snapshot(store: TableStore, source: str, tables: list[str] | None = None) -> list[Manifest]:
    """Publish the tables of a snapshot as their next version, marks included."""
    names = tables or [name for name, _ in store.files.children(source)]
    restored = []
    for name in names:
        saved = Manifest.from_text(store.files.read(f"{source}/{name}/manifest.json"))
        head = store.head(name)
        rows = store.spark.read.schema(saved.struct).parquet(f"{source}/{name}/rows")
        parts = store.write_segment(name, new_run_id(), rows, saved.layout)
        restored.append(
            store.commit(
                replace(
                    saved,
                    version=(head.version if head else 0) + 1,
                    run_id=new_run_id(),
                    load_mode="restore",
                    parts=tuple(parts),
                    row_count=sum(p.rows for p in parts),
                    rows_written=sum(p.rows for p in parts),
                    landing_path=None,
                    committed_at=iso(utc_now()),
                )
            )
        )
    return restored


# --- expiry -----------------------------------------------------------------------------


def expire_landing(store: TableStore, table: str, as_of: datetime, days: int = 30) -> list[str]:
    """Delete landed runs older than ``days`` that no version is made of."""
    in_use = {p.path for m in store.history(table) for p in m.parts}
    cutoff_ms = as_of.timestamp() * 1000 - days * 86_400_000
    removed = []
    for name, changed in store.files.children(store.landing_dir(table)):
        if changed < cutoff_ms and f"landing/{table}/{name}" not in in_use:
            store.files.remove(f"{store.landing_dir(table)}/{name}")
            removed.append(name)
    return removed


def expire_versions(store: TableStore, table: str, keep: int) -> list[int]:
    """Forget versions before the newest ``keep`` and delete parts only they used.

    Versions that a rebuild would start from stay: those from the newest one on that stands for
    the whole table.
    """
    known = store.versions(table)
    base = max((m.version for m in store.history(table) if m.load_mode in WHOLE_MODES), default=known[0])
    old = [v for v in known[:-keep] if v < base]
    kept = [v for v in known if v not in old]
    needed = {p.path for v in kept for p in store.manifest(table, v).parts}
    orphans = {p.path for v in old for p in store.manifest(table, v).parts} - needed
    for version in old:
        store.files.remove(f"{store.registry_dir(table)}/{version:010d}.json")
    for path in orphans:
        store.files.remove(f"{store.root}/{path}")
    return old
