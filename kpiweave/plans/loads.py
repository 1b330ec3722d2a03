"""Loading: landed rows or a SELECT into a table, by full refresh, append or upsert."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.functions.predicates import field_of
from kpiweave.functions.sizing import estimated_bytes
from kpiweave.operators.incremental import capped, later_mark
from kpiweave.operators.merge import latest_per_key, upserted
from kpiweave.operators.schemas import SchemaDrift, aligned
from kpiweave.plans import runs
from kpiweave.plans.store import (
    CommitConflict,
    Layout,
    Manifest,
    Part,
    TableStore,
    choose_layout,
    iso,
    new_run_id,
    utc_now,
)
from kpiweave.session import transform_session
from kpiweave.sources.landing import Landed, land
from kpiweave.sources.registry import Surroundings, read_source
from kpiweave.sources.sqlguard import check_select
from kpiweave.specs import JobSpec, LoadCommand, SpecError, WatermarkSpec

RESERVED = ("_run", "_day", "_bucket")
COMMIT_TRIES = 8


@dataclass(frozen=True)
class LoadResult:
    table: str
    rows_written: int
    row_count: int
    table_version: int


@dataclass(frozen=True)
class LoadOptions:
    """Choices beyond the load command itself.

    exactly_once  skip a run id that the table has already taken (append, streaming)
    dedupe_by     keep one row per key in the batch, the greatest by this column
    null_safe     let NULL keys match each other
    on_drift      "fail", or "quarantine" to set a misfitting batch aside
    layout        layout of a new table; chosen from keys and watermark if None
    """

    exactly_once: bool = False
    dedupe_by: str | None = None
    null_safe: bool = False
    on_drift: str = "fail"
    layout: Layout | None = None


# --- transforms -------------------------------------------------------------------


Reader = Callable[[SparkSession], DataFrame]


def select_over(spark: SparkSession, readers: Mapping[str, Reader], sql: str) -> tuple[DataFrame, tuple[str, ...]]:
    """A checked SELECT over named inputs, and the inputs it names.

    It runs in a sibling session, where double quotes mark identifiers and only the
    named inputs are visible as views.
    """
    checked = check_select(spark, sql)
    known = {name.lower(): name for name in readers}
    session = transform_session(spark)
    used = []
    for name in checked.tables:
        if name.lower() not in known:
            raise SpecError(f"unknown table {name!r}")
        used.append(known[name.lower()])
        readers[used[-1]](session).createOrReplaceTempView(used[-1])
    return session.sql(checked.text), tuple(used)


def transform_frame(store: TableStore, sql: str) -> tuple[DataFrame, dict[str, int]]:
    """A checked SELECT over the loaded tables, and the versions it reads."""
    # Versions are fixed before the SELECT is planned, so that one run sees one state.
    heads = {table: store.versions(table)[-1] for table in store.tables()}

    def reader(table: str, version: int) -> Reader:
        return lambda session: TableStore(session, store.root).read(table, version)

    frame, used = select_over(store.spark, {t: reader(t, v) for t, v in heads.items()}, sql)
    return frame, {table: heads[table] for table in used}


def preview_sql(store: TableStore, sql: str, cap: int = 200) -> DataFrame:
    return transform_frame(store, sql)[0].limit(cap)


@dataclass(frozen=True)
class Batch:
    """The rows of a load; ``path`` where they lie unchanged, ``known`` their count."""

    rows: DataFrame
    path: str | None
    known: int | None

    def count(self) -> int:
        # Of Parquet files as they lie, a count reads the footers only.
        return self.rows.count() if self.known is None else self.known

    def bytes(self, store: TableStore) -> int:
        return store.files.size(self.path) if self.path else estimated_bytes(self.rows)

    def aligned(self, schema: T.StructType) -> Batch:
        """In the table's form; still as it lies when only the column order differs."""
        own = {f.name: f.dataType for f in self.rows.schema.fields}
        same = own == {f.name: f.dataType for f in schema.fields}
        return Batch(aligned(self.rows, schema), self.path if same else None, self.known)


# --- one load -----------------------------------------------------------------------


def load(
    store: TableStore,
    command: LoadCommand,
    options: LoadOptions | None = None,
    note: str | None = None,
    inputs: dict[str, int] | None = None,
    landed: Landed | None = None,
    attempt: int = 1,
) -> LoadResult:
    """Apply one load command and record its run.

    A failure leaves the table at its last version and the run marked failed. ``note``
    and ``inputs`` are kept with the new version; ``landed`` saves looking up the schema
    and row count of a batch that was landed just now.
    """
    options = options or LoadOptions()
    before = store.head(command.table)
    run = runs.begin(
        store,
        run_id=command.run_id,
        table_name=command.table,
        job_name=command.job_name,
        attempt=attempt,
        rows_read=command.rows_read,
        watermark_before=before.watermark_value if before else None,
        landing_path=command.landing_path,
    )
    landings: dict[str, str] = {}  # where a transform's rows were landed
    try:
        return _load(store, command, options, run, note, dict(inputs or {}), landed, landings)
    except SchemaDrift as drift:
        status = "failed"
        if options.on_drift == "quarantine":
            _quarantine(store, command, drift, command.landing_path or landings.get(command.run_id))
            status = "quarantined"
        runs.finish(store, run, status, error=f"load failed: {drift}")
        raise
    except Exception as error:
        runs.finish(store, run, "failed", error=f"load failed: {error}"[:2000])
        raise


def _load(
    store: TableStore,
    command: LoadCommand,
    options: LoadOptions,
    run: runs.Run,
    note: str | None,
    inputs: dict[str, int],
    landed: Landed | None,
    landings: dict[str, str],
) -> LoadResult:
    if command.transform_sql:
        # The SELECT runs once; everything after reads what it wrote.
        frame, inputs = transform_frame(store, command.transform_sql)
        landed = land(frame, store.landing_path(command.table, f"{command.run_id}-{uuid.uuid4().hex[:8]}"))
    landing = landed.path if landed else command.landing_path
    landings[command.run_id] = landing
    reader = store.spark.read.schema(landed.schema) if landed else store.spark.read
    source = Batch(reader.parquet(landing), landing, landed.rows_read if landed else None)
    batch = source.rows
    clash = [c for c in batch.columns if c.lower() in RESERVED]
    if clash:
        raise SpecError(f"column names kept for table layout: {', '.join(clash)}")
    if options.dedupe_by:
        batch = latest_per_key(batch, command.key_columns, options.dedupe_by)
        source = Batch(batch, None, None)
    for _ in range(COMMIT_TRIES):
        head = store.head(command.table)
        if head and options.exactly_once and command.run_id in head.applied_runs:
            runs.finish(store, run, "success", rows_written=0, watermark_after=head.watermark_value)
            return LoadResult(command.table, 0, head.row_count, head.version)
        planned = _next_version(store, command, options, head, source, inputs, run)
        planned = replace(planned, note=note, landing_path=landing)
        try:
            done = store.commit(planned)
        except CommitConflict:
            continue
        runs.finish(
            store,
            run,
            "success",
            rows_written=done.rows_written,
            watermark_after=done.watermark_value,
            landing_path=landing,
        )
        return LoadResult(done.table, done.rows_written, done.row_count, done.version)
    raise CommitConflict(f"gave up on {command.table} after {COMMIT_TRIES} conflicts")


def _next_version(
    store: TableStore,
    command: LoadCommand,
    options: LoadOptions,
    head: Manifest | None,
    source: Batch,
    inputs: dict[str, int],
    run: runs.Run,
) -> Manifest:
    fresh = head is None or command.load_mode == "full"
    if not fresh:
        source = source.aligned(head.struct)
    keys = tuple(field_of(source.rows.schema, k).name for k in command.key_columns)
    mark_column = command.watermark.column if command.watermark else (head.watermark_column if head else None)
    if fresh:
        schema = source.rows.schema
        previous_keys = head.key_columns if head else ()
        keys = keys or tuple(k for k in previous_keys if k in schema.names)
        if mark_column is not None and mark_column.lower() not in {n.lower() for n in schema.names}:
            mark_column = None
        mode = "upsert" if keys else command.load_mode
        layout = options.layout or choose_layout(schema, mode, keys, mark_column, source.bytes(store))
        old_parts: tuple[Part, ...] = ()
    else:
        schema, layout = head.struct, head.layout
        old_parts = head.parts

    if command.load_mode == "upsert" and old_parts:
        if not layout.serves(keys):
            # Loaded by other keys so far: spread the table anew for these.
            size = sum(store.files.size(f"{store.root}/{p.path}") for p in old_parts)
            layout = options.layout or choose_layout(schema, "upsert", keys, mark_column, size)
        new_parts, kept_parts, written = _merge(store, command, options, head, source, layout, keys)
    else:
        new_parts = _add(store, command, source, layout)
        kept_parts, written = old_parts, sum(p.rows for p in new_parts)
    parts = (*kept_parts, *new_parts)
    return Manifest(
        table=command.table,
        version=(head.version if head else 0) + 1,
        run_id=command.run_id,
        load_mode=command.load_mode,
        schema=schema.json(),
        parts=parts,
        row_count=sum(p.rows for p in parts),
        rows_written=written,
        layout=layout,
        key_columns=keys or (head.key_columns if head else ()),
        watermark_column=mark_column,
        watermark_value=_mark_after(head, schema, mark_column, command.watermark_value, fresh),
        source_job=command.job_name or (head.source_job if head else None),
        applied_runs=(*(head.applied_runs if head else ()), command.run_id),
        inputs=inputs,
        started_at=run.started_at,
        committed_at=iso(utc_now()),
    )


def _mark_after(
    head: Manifest | None, schema: T.StructType, column: str | None, new: str | None, fresh: bool
) -> str | None:
    """The table's mark after a load: the batch's own for a fresh table, else the greater one."""
    old = head.watermark_value if head else None
    if fresh or column is None or head.watermark_column != column:
        return new or old
    return later_mark(field_of(schema, column).dataType, old, new)


def _add(store: TableStore, command: LoadCommand, source: Batch, layout: Layout) -> list[Part]:
    """The batch as new parts. A landing directory of the store that already has the
    table's form becomes a part as it is, so that rows are not written twice."""
    if source.path and source.path.startswith(f"{store.root}/landing/") and not layout.columns:
        count = source.count()
        return [Part(source.path.removeprefix(f"{store.root}/"), count)] if count else []
    return store.write_segment(command.table, command.run_id, source.rows, layout)


def _merge(
    store: TableStore,
    command: LoadCommand,
    options: LoadOptions,
    head: Manifest,
    source: Batch,
    layout: Layout,
    keys: tuple[str, ...],
) -> tuple[list[Part], tuple[Part, ...], int]:
    """Copy-on-write upsert of the parts whose place the batch touches."""
    batch, written = source.rows, source.count()
    if layout.columns and layout == head.layout:
        # One row per touched day or bucket, bounded by the layout and not by the batch.
        places = layout.place(batch).select(*layout.columns).distinct().collect()
        touched = {tuple(None if v is None else str(v) for v in row) for row in places}
        affected = [p for p in head.parts if p.place in touched]
    else:
        affected = list(head.parts)
    untouched = tuple(p for p in head.parts if p not in affected)
    target = store.rows_of(head, affected).select(*[F.col(f"`{n}`") for n in head.struct.names])
    merged = upserted(target, batch, keys, options.null_safe) if affected else batch
    return store.write_segment(command.table, command.run_id, merged, layout), untouched, written


def _quarantine(store: TableStore, command: LoadCommand, drift: SchemaDrift, landing_path: str | None) -> None:
    base = f"{store.root}/quarantine/{command.table}/_run={command.run_id}"
    if landing_path:
        store.spark.read.parquet(landing_path).write.mode("overwrite").parquet(f"{base}/rows")
    about = {"run_id": command.run_id, "table": command.table, "drift": drift.drift.summary()}
    store.files.put(f"{base}/drift.json", json.dumps(about))


# --- conveniences -----------------------------------------------------------------


def load_frame(
    store: TableStore,
    table: str,
    frame: DataFrame,
    load_mode: str = "full",
    key_columns: tuple[str, ...] = (),
    watermark: WatermarkSpec | None = None,
    run_id: str | None = None,
    job_name: str | None = None,
    options: LoadOptions | None = None,
) -> LoadResult:
    """Land a DataFrame and load it."""
    run_id = run_id or new_run_id()
    # A repeated run id lands again beside the first; replay tells them apart by version.
    landed = land(frame, _free_landing(store, table, run_id), watermark.column if watermark else None)
    command = LoadCommand(
        run_id=run_id,
        table=table,
        load_mode=load_mode,
        landing_path=landed.path,
        key_columns=tuple(key_columns),
        watermark=watermark,
        watermark_value=landed.new_watermark,
        rows_read=landed.rows_read,
        job_name=job_name,
    )
    return load(store, command, options, landed=landed)


def _free_landing(store: TableStore, table: str, run_id: str) -> str:
    path = store.landing_path(table, run_id)
    return f"{path}-{uuid.uuid4().hex[:8]}" if store.files.exists(path) else path


@contextmanager
def time_limit(store: TableStore, seconds: int | None, label: str) -> Iterator[None]:
    """Cancel this thread's Spark jobs when they run longer than ``seconds``."""
    if not seconds:
        yield
        return
    context = store.spark.sparkContext
    group = f"{label}-{uuid.uuid4().hex[:8]}"
    context.setJobGroup(group, label, interruptOnCancel=True)
    timer = threading.Timer(seconds, context.cancelJobGroup, args=[group])
    timer.daemon = True
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)


def extract(store: TableStore, job: JobSpec, around: Surroundings, run_id: str) -> tuple[LoadCommand, Landed]:
    """Land what is new since the table's mark; returns the load it asks for."""
    head = store.head(job.target_table)
    # A full refresh replaces the table, so it reads everything: no mark and no cap.
    whole = job.load_mode == "full"
    mark = head.watermark_value if head and job.watermark and not whole else None
    column = job.watermark.column if job.watermark else None
    frame = read_source(store.spark, job, around, mark)
    if not whole:
        frame = capped(frame, column if column in frame.columns else None, job.guards.row_cap, mark is None)
    landed = land(frame, store.landing_path(job.target_table, run_id), column, mark)
    command = LoadCommand(
        run_id=run_id,
        table=job.target_table,
        load_mode=job.load_mode,
        landing_path=landed.path,
        key_columns=job.key_columns,
        watermark=job.watermark,
        watermark_value=landed.new_watermark,
        rows_read=landed.rows_read,
        job_name=job.name,
    )
    return command, landed


def run_job(
    store: TableStore,
    job: JobSpec,
    around: Surroundings | None = None,
    options: LoadOptions | None = None,
    run_id: str | None = None,
    attempt: int = 1,
) -> LoadResult:
    """Extract, land, load; the mark advances only with the commit."""
    around = around or Surroundings()
    run_id = run_id or new_run_id()
    landed = None
    if job.source.kind == "duckdb_query":
        command = LoadCommand(
            run_id=run_id,
            table=job.target_table,
            load_mode=job.load_mode,
            transform_sql=job.source.transform_sql,
            key_columns=job.key_columns,
            watermark=job.watermark,
            job_name=job.name,
        )
    else:
        try:
            with time_limit(store, job.guards.timeout_s, job.name):
                command, landed = extract(store, job, around, run_id)
        except Exception as error:
            run = runs.begin(store, run_id=run_id, table_name=job.target_table, job_name=job.name, attempt=attempt)
            runs.finish(store, run, "failed", error=f"extract failed: {error}"[:2000])
            raise
    return load(store, command, options, landed=landed, attempt=attempt)


def run_job_retrying(
    store: TableStore,
    job: JobSpec,
    around: Surroundings | None = None,
    options: LoadOptions | None = None,
    tries: int = 5,
    first_wait_s: float = 1.0,
    longest_wait_s: float = 600.0,
    sleep: Callable[[float], None] = time.sleep,
) -> LoadResult:
    """Run a job again after failures, waiting twice as long each time.

    Every try has its own run record. All share one stem, and a try that finds an earlier
    one committed after all takes its result, so no batch is loaded twice. A definition
    or a batch that cannot be loaded is not tried again.
    """
    stem = new_run_id()
    taken = replace(options or LoadOptions(), exactly_once=True)
    for attempt in range(1, tries + 1):
        head = store.head(job.target_table)
        if head and head.run_id.startswith(stem):
            return LoadResult(head.table, head.rows_written, head.row_count, head.version)
        try:
            return run_job(store, job, around, taken, f"{stem}-try{attempt}", attempt)
        except (SpecError, SchemaDrift, LookupError):
            raise
        except Exception:
            if attempt == tries:
                raise
            sleep(min(longest_wait_s, first_wait_s * 2 ** (attempt - 1)))
    raise AssertionError("unreachable")


def load_csv(store: TableStore, path: str, table: str, columns: tuple[str, ...] = ()) -> LoadResult:
    """One CSV file (or glob) into a table by full refresh."""
    from kpiweave.sources.csv_files import read_csv

    return load_frame(store, table, read_csv(store.spark, path, columns), "full", job_name=f"load_{table}")
