from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpiweave.operators.merge import latest_per_key, replayed, upserted
from kpiweave.operators.schemas import SchemaDrift, compare
from kpiweave.plans import loads
from kpiweave.plans.exports import export_table
from kpiweave.plans.loads import LoadOptions, load, load_csv, load_frame, preview_sql, run_job, run_job_retrying, time_limit
from kpiweave.plans.maintain import (
    apply_retention,
    compact,
    expire_landing,
    expire_versions,
    export_snapshot,
    import_snapshot,
    rebuild,
)
from kpiweave.plans.runs import run_log
from kpiweave.plans.store import CommitConflict, Layout, TableNotFound, TableStore, choose_layout
from kpiweave.sources.registry import Surroundings
from kpiweave.specs import Filter, Guards, JobSource, JobSpec, LoadCommand, QuerySpec, Retention, Schedule, SpecError, WatermarkSpec

from .conftest import rows_of

CELLS = "cell_id string, ts bigint, traffic double"
KEYS = ("cell_id", "ts")


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), CELLS)


def test_full_then_upsert_is_idempotent(spark, store):
    first = load_frame(store, "cs", cells(spark, ("A", 1, 10.0), ("B", 1, 20.0)), "full")
    assert (first.row_count, first.table_version) == (2, 1)
    batch = cells(spark, ("B", 1, 25.0), ("C", 2, 30.0))
    for version in (2, 3):
        result = load_frame(store, "cs", batch, "upsert", KEYS, run_id="r2")
        assert (result.row_count, result.rows_written, result.table_version) == (3, 2, version)
    assert rows_of(store.read("cs").filter("cell_id = 'B'")) == [("B", 1, 25.0)]
    head = store.manifest("cs")
    assert head.row_count == store.read("cs").count() == 3
    assert head.struct.names == ["cell_id", "ts", "traffic"]


def test_full_replaces_the_schema(spark, store):
    load_frame(store, "t", cells(spark, ("A", 1, 1.0)), "full")
    load_frame(store, "t", spark.range(3), "full")
    assert store.read("t").columns == ["id"]
    assert store.read("t", 1).columns == ["cell_id", "ts", "traffic"]


def test_append_doubles_on_replay_unless_taken_once(spark, store):
    batch = cells(spark, ("A", 1, 1.0))
    load_frame(store, "t", batch, "append", run_id="r")
    assert load_frame(store, "t", batch, "append", run_id="r").row_count == 2
    again = load_frame(store, "t", batch, "append", run_id="r", options=LoadOptions(exactly_once=True))
    assert (again.row_count, again.rows_written, again.table_version) == (2, 0, 2)


def test_upsert_keeps_batch_duplicates_and_null_keys_accumulate(spark, store):
    batch = cells(spark, ("A", 1, 1.0), ("A", 1, 2.0), (None, 1, 3.0), ("B", None, 4.0))
    load_frame(store, "t", batch, "upsert", KEYS)
    load_frame(store, "t", batch, "upsert", KEYS)
    assert store.read("t").count() == 6  # two of A, twice the two with a NULL in the key
    load_frame(store, "t", batch, "upsert", KEYS, options=LoadOptions(null_safe=True))
    assert store.read("t").count() == 4


def test_upsert_dedupe_keeps_the_greatest(spark, store):
    batch = cells(spark, ("A", 1, 1.0), ("A", 1, 2.0), ("B", 1, 5.0))
    load_frame(store, "t", batch, "upsert", KEYS, options=LoadOptions(dedupe_by="traffic"))
    assert rows_of(store.read("t")) == [("A", 1, 2.0), ("B", 1, 5.0)]


keyed_rows = st.lists(st.tuples(st.sampled_from(["A", "B", "C", None]), st.integers(0, 2), st.integers(0, 9).map(float)), max_size=8)


def merged_by_hand(target, batch):
    arriving = {r[:2] for r in batch if None not in r[:2]}
    return [r for r in target if None in r[:2] or r[:2] not in arriving] + batch


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(keyed_rows, min_size=2, max_size=4))
def test_upsert_and_replay_laws(spark, batches):
    state = []
    for batch in batches:
        state = merged_by_hand(state, batch)
    frames = [cells(spark, *b) for b in batches]
    by_merge = frames[0]
    for frame in frames[1:]:
        by_merge = upserted(by_merge, frame, KEYS)
    want = sorted(state, key=repr)
    assert rows_of(by_merge) == want
    numbered = [f.withColumn("at", F.lit(i)) for i, f in enumerate(frames)]
    runs = numbered[0]
    for frame in numbered[1:]:
        runs = runs.unionByName(frame)
    assert rows_of(replayed(runs, KEYS, "at")) == want


@pytest.mark.parametrize("layout", [None, Layout(buckets=4, keys=KEYS), Layout(buckets=1, keys=KEYS)])
def test_layouts_do_not_change_results(spark, store, layout):
    rows = [(f"C{i}", i % 5, float(i)) for i in range(40)]
    options = LoadOptions(layout=layout)
    load_frame(store, "t", cells(spark, *rows), "upsert", KEYS, options=options)
    batch = [(f"C{i}", i % 5, -1.0) for i in range(0, 40, 7)] + [("new", 1, 1.0)]
    load_frame(store, "t", cells(spark, *batch), "upsert", KEYS, options=options)
    assert rows_of(store.read("t")) == sorted(merged_by_hand(rows, batch), key=repr)
    assert store.manifest("t").row_count == 41


def hourly(spark, days, cell="A", start=datetime(2024, 1, 1)):
    rows = [(cell, start + timedelta(hours=h), float(h)) for h in range(24 * days)]
    return spark.createDataFrame(rows, "cell string, ts timestamp_ntz, v double")


def test_upsert_by_day_rewrites_only_touched_days(spark, store):
    mark = WatermarkSpec("ts")
    load_frame(store, "t", hourly(spark, 5), "upsert", ("cell", "ts"), mark)
    before = {p.place: p.path for p in store.manifest("t").parts}
    assert len(before) == 5 and store.manifest("t").layout.day == "ts"
    late = hourly(spark, 1, start=datetime(2024, 1, 3)).withColumn("v", F.lit(-1.0))
    load_frame(store, "t", late, "upsert", ("cell", "ts"), mark)
    after = {p.place: p.path for p in store.manifest("t").parts}
    assert {k for k in after if after[k] != before[k]} == {("2024-01-03",)}
    assert store.read("t").count() == 120 and store.read("t").filter("v = -1").count() == 24


def test_null_days_are_kept_and_found(spark, store):
    frame = hourly(spark, 2).unionByName(spark.createDataFrame([("A", None, 0.5)], "cell string, ts timestamp_ntz, v double"))
    load_frame(store, "t", frame, "append", watermark=WatermarkSpec("ts"))
    assert store.read("t").count() == 49
    assert store.query(QuerySpec("t", filters=(Filter("ts", "is_null"),))).rows.count() == 1


def test_day_filters_prune_partitions(spark, store):
    load_frame(store, "t", hourly(spark, 6), "append", watermark=WatermarkSpec("ts"))
    cases = [
        (("=", "2024-01-02 03:00:00"), 1),
        ((">", "2024-01-05 22:00:00"), 25),
        (("<=", "2024-01-01 01:00:00"), 2),
        (("between", ["2024-01-02", "2024-01-03"]), 25),
        (("in", ["2024-01-02", "2024-01-04"]), 2),
        (("!=", "2024-01-02"), 143),
    ]
    for (op, value), count in cases:
        rows = store.query(QuerySpec("t", filters=(Filter("ts", op, value),))).rows
        assert rows.count() == count, op
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert ("PartitionFilters: []" in plan) == (op == "!=")


def test_bucket_filters_prune_partitions(spark, store):
    rows = [(f"C{i}", i % 5, float(i)) for i in range(40)]
    load_frame(store, "t", cells(spark, *rows), "upsert", KEYS, options=LoadOptions(layout=Layout(buckets=4, keys=KEYS)))
    spec = QuerySpec("t", filters=(Filter("cell_id", "=", "C7"), Filter("ts", "=", "2")))
    result = store.query(spec).rows
    assert "_bucket" in result._jdf.queryExecution().executedPlan().toString()
    assert rows_of(result) == [("C7", 2, 7.0)]


def test_layout_choice(spark):
    schema = hourly(spark, 1).schema
    assert choose_layout(schema, "append", (), "ts", 10).day == "ts"
    assert choose_layout(schema, "upsert", ("cell", "ts"), "ts", 10).day == "ts"
    assert choose_layout(schema, "upsert", ("cell",), "ts", 10) == Layout(keys=("cell",))
    assert choose_layout(schema, "upsert", ("cell",), None, 10 << 30).buckets == 20
    assert choose_layout(schema, "append", (), "v", 10) == Layout()


def test_batches_align_by_name_and_drift_is_refused(spark, store):
    load_frame(store, "t", cells(spark, ("A", 1, 1.0)), "append")
    reordered = spark.createDataFrame([(2.0, "B", 2)], "traffic double, cell_id string, ts int")
    load_frame(store, "t", reordered, "append")
    assert rows_of(store.read("t")) == [("A", 1, 1.0), ("B", 2, 2.0)]
    for bad in (
        spark.createDataFrame([("B", 2)], "cell_id string, ts bigint"),
        spark.createDataFrame([("B", 2, 2.0, 1)], CELLS + ", extra int"),
        spark.createDataFrame([("B", "2", 2.0)], "cell_id string, ts string, traffic double"),
    ):
        with pytest.raises(SchemaDrift):
            load_frame(store, "t", bad, "append")
    assert store.manifest("t").version == 2
    drift = compare(store.manifest("t").struct, reordered.schema)
    assert drift.reordered and not drift.blocking


def test_drifting_batch_is_quarantined(spark, store):
    load_frame(store, "t", cells(spark, ("A", 1, 1.0)), "append")
    with pytest.raises(SchemaDrift):
        load_frame(store, "t", spark.range(4), "append", run_id="bad", options=LoadOptions(on_drift="quarantine"))
    assert spark.read.parquet(f"{store.root}/quarantine/t/_run=bad/rows").count() == 4
    assert [r.status for r in run_log(store).orderBy("started_at").collect()] == ["success", "quarantined"]


def test_reserved_names_are_refused(spark, store):
    with pytest.raises(SpecError):
        load_frame(store, "t", spark.range(1).withColumnRenamed("id", "_day"), "full")


def test_crash_before_commit_is_invisible(spark, store, monkeypatch):
    load_frame(store, "t", cells(spark, ("A", 1, 1.0)), "full")
    monkeypatch.setattr(TableStore, "commit", lambda self, m: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        load_frame(store, "t", cells(spark, ("B", 2, 2.0)), "upsert", KEYS)
    monkeypatch.undo()
    assert rows_of(store.read("t")) == [("A", 1, 1.0)]
    failed = run_log(store).filter("status = 'failed'").collect()
    assert len(failed) == 1 and "gone" in failed[0].error


def test_lost_commit_race_retries_on_the_new_head(spark, store, monkeypatch):
    load_frame(store, "t", cells(spark, ("A", 1, 1.0)), "full")
    real, raced = TableStore.commit, []

    def commit(self, manifest):
        if not raced:
            raced.append(1)
            # Another writer takes the version first.
            load_frame(TableStore(spark, self.root), "t", cells(spark, ("B", 1, 9.0), ("C", 1, 3.0)), "upsert", KEYS)
        return real(self, manifest)

    monkeypatch.setattr(TableStore, "commit", commit)
    result = load_frame(store, "t", cells(spark, ("B", 1, 2.0)), "upsert", KEYS)
    assert result.table_version == 3
    assert rows_of(store.read("t")) == [("A", 1, 1.0), ("B", 1, 2.0), ("C", 1, 3.0)]


def test_commit_is_create_if_absent(spark, store):
    load_frame(store, "t", spark.range(1), "full")
    with pytest.raises(CommitConflict):
        store.commit(store.manifest("t"))


def test_versions_stay_readable_and_unknown_ones_are_not(spark, store):
    for n in (1, 2, 3):
        load_frame(store, "t", spark.range(n), "full")
    assert [store.read("t", v).count() for v in store.versions("t")] == [1, 2, 3]
    result = store.query(QuerySpec("t", table_version_pin=2, include_sql=True), with_total=True)
    assert (result.rows.count(), result.total, result.table_version) == (2, 2, 2)
    assert result.sql.startswith('SELECT * FROM "t"')
    with pytest.raises(TableNotFound):
        store.read("t", 9)
    with pytest.raises(TableNotFound):
        store.read("nothing")
    assert store.tables() == ["t"]


def test_transform_and_preview(spark, store):
    load_frame(store, "base_kpi", spark.createDataFrame([("North", 10), ("North", 30), ("South", 20)], "region string, traffic int"))
    sql = 'SELECT "region", sum("traffic") AS total FROM base_kpi GROUP BY "region";'
    result = load(store, LoadCommand("x", "by_region", "full", transform_sql=sql))
    assert result.rows_written == 2
    assert rows_of(store.read("by_region")) == [("North", 40), ("South", 20)]
    assert store.manifest("by_region").inputs == {"base_kpi": 1}
    assert preview_sql(store, sql).count() == 2
    for bad in ("DROP TABLE base_kpi", "SELECT * FROM elsewhere"):
        with pytest.raises(SpecError):
            load(store, LoadCommand("y", "z", "full", transform_sql=bad))
    # The caller's session keeps its own settings and sees no views.
    assert not spark.catalog.tableExists("base_kpi")


def test_incremental_job_reads_after_the_mark(spark, store, tmp_path):
    def write(name, rows):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, "n int, v string").coalesce(1).write.option("header", True).csv(path)
        return path

    job = JobSpec(
        "inc",
        JobSource("csv", upload_id="u"),
        "t",
        Schedule(every="1h"),
        "append",
        WatermarkSpec("n", "integer"),
    )
    rows = [(i, f"r{i}") for i in range(1, 10)]
    run_job(store, job, Surroundings(uploads={"u": write("a", rows)}))
    assert store.manifest("t").watermark_value == "9"
    more = write("b", rows + [(10, "r10"), (11, "r11")])
    result = run_job(store, job, Surroundings(uploads={"u": more}))
    # "9" is below "10" although its text is not.
    assert (result.rows_written, result.row_count) == (2, 11)
    empty = run_job(store, job, Surroundings(uploads={"u": more}))
    assert (empty.rows_written, empty.row_count) == (0, 11)
    assert store.manifest("t").watermark_value == "11"
    log = run_log(store).orderBy("started_at").collect()
    assert [(r.rows_read, r.watermark_before, r.watermark_after) for r in log] == [(9, None, "9"), (2, "9", "11"), (0, "11", "11")]


def test_capped_runs_lose_nothing(spark, store, tmp_path):
    path = str(tmp_path / "in")
    rows = [(i // 4, i) for i in range(40)]  # four rows share each mark
    spark.createDataFrame(rows, "n int, v int").coalesce(1).write.option("header", True).csv(path)
    job = JobSpec(
        "capped", JobSource("csv", upload_id="u"), "t", Schedule(every="1h"), "append", WatermarkSpec("n", "integer"),
        guards=Guards(row_cap=10, timeout_s=None),
    )
    written = [run_job(store, job, Surroundings(uploads={"u": path})).rows_written for _ in range(6)]
    assert written == [8, 8, 8, 8, 8, 0]
    assert sorted(r.v for r in store.read("t").collect()) == list(range(40))


def test_cap_smaller_than_one_mark_takes_the_whole_mark(spark, store, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, i) for i in range(9)] + [(2, 9)], "n int, v int").coalesce(1).write.option("header", True).csv(path)
    job = JobSpec(
        "capped", JobSource("csv", upload_id="u"), "t", Schedule(every="1h"), "append", WatermarkSpec("n", "integer"),
        guards=Guards(row_cap=3),
    )
    assert [run_job(store, job, Surroundings(uploads={"u": path})).rows_written for _ in range(3)] == [9, 1, 0]


def test_a_cap_keeps_rows_without_a_mark(spark, store, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(None if i % 4 == 0 else i, i) for i in range(40)], "n int, v int").coalesce(1).write.option("header", True).csv(path)
    job = JobSpec(
        "capped", JobSource("csv", upload_id="u"), "t", Schedule(every="1h"), "append", WatermarkSpec("n", "integer"),
        guards=Guards(row_cap=5),
    )
    for _ in range(8):
        run_job(store, job, Surroundings(uploads={"u": path}))
    assert sorted(r.v for r in store.read("t").collect()) == list(range(40))


def test_a_full_refresh_ignores_mark_and_cap(spark, store, tmp_path):
    job = JobSpec(
        "f", JobSource("csv", upload_id="u"), "t", Schedule(every="1h"), "full", WatermarkSpec("n", "integer"), guards=Guards(row_cap=1)
    )
    counts = []
    for most in (2, 3, 3):
        path = str(tmp_path / f"in{len(counts)}")
        spark.createDataFrame([(i, i) for i in range(most)], "n int, v int").coalesce(1).write.option("header", True).csv(path)
        counts.append(run_job(store, job, Surroundings(uploads={"u": path})).row_count)
    assert counts == [2, 3, 3]


@pytest.mark.parametrize(
    ("kind", "old", "new", "kept"),
    [("bigint", "10", "9", "10"), ("timestamp", "2024-01-01T10:00:00", "2024-01-01T05:00:00", "2024-01-01T10:00:00"),
     ("string", "b", "a", "b"), ("double", None, "2.5", "2.5"), ("date", "2024-01-02", "2024-01-03", "2024-01-03")],
)
def test_marks_never_go_back(kind, old, new, kept):
    from pyspark.sql import types as T

    from kpiweave.operators.incremental import later_mark

    assert later_mark(T.StructType.fromDDL(f"c {kind}")["c"].dataType, old, new) == kept


def test_a_late_batch_leaves_the_mark(spark, store):
    for hours in ((10, 11), (5,)):
        frame = spark.createDataFrame([(h,) for h in hours], "n int")
        load_frame(store, "late", frame, "append", watermark=WatermarkSpec("n", "integer"))
    assert store.manifest("late").watermark_value == "11"


def test_batches_of_exact_values_fit_the_table(spark, store):
    load_frame(store, "w", spark.createDataFrame([(1.5, "a")], "traffic double, name string"), "append")
    load_frame(store, "w", spark.createDataFrame([(2, "b")], "traffic bigint, name string"), "append")
    load_frame(store, "w", spark.createDataFrame([(None, "c")], "traffic string, name string"), "append")
    assert rows_of(store.read("w")) == [(1.5, "a"), (2.0, "b"), (None, "c")]
    for value, kind in ((2**53 + 1, "bigint"), ("3.5", "string")):
        with pytest.raises(SchemaDrift):
            load_frame(store, "w", spark.createDataFrame([(value, "d")], f"traffic {kind}, name string"), "append")
    load_frame(store, "d", spark.createDataFrame([("1.25",)], "v string").selectExpr("cast(v as decimal(10,2)) as v"), "append")
    load_frame(store, "d", spark.createDataFrame([(7,)], "v bigint"), "append")
    assert sorted(str(r.v) for r in store.read("d").collect()) == ["1.25", "7.00"]


def test_failed_extract_is_recorded(spark, store):
    job = JobSpec("j", JobSource("csv", upload_id="missing"), "t", Schedule(every="1h"), "full")
    with pytest.raises(LookupError):
        run_job(store, job)
    row = run_log(store).first()
    assert row.status == "failed" and row.error.startswith("extract failed") and row.finished_at is not None


def test_synthetic_job_is_deterministic_and_incremental(spark, store):
    columns = ("timestamp", "cell_id", "region", "throughput_mbps", "latency_ms")
    job = JobSpec(
        "ps", JobSource("synthetic", columns=columns), "ps", Schedule(every="1h"), "upsert",
        WatermarkSpec("timestamp"), ("cell_id", "timestamp"),
    )
    noon = datetime(2024, 5, 5, 12, 34)
    assert run_job(store, job, Surroundings(as_of=noon)).row_count == 588
    first = rows_of(store.read("ps"))
    again = run_job(store, job, Surroundings(as_of=noon))
    assert (again.rows_written, again.row_count) == (0, 588)
    later = run_job(store, job, Surroundings(as_of=noon + timedelta(hours=2)))
    assert (later.rows_written, later.row_count) == (24, 612)
    assert rows_of(store.read("ps").filter("timestamp <= '2024-05-05 12:00:00'")) == first
    row = store.read("ps").agg(F.min("latency_ms"), F.min("throughput_mbps"), F.avg("latency_ms")).first()
    assert row[0] >= 1 and row[1] >= 0 and 30 < row[2] < 40


def test_one_shot_csv(spark, store, tmp_path):
    (tmp_path / "kpi.csv").write_text("site,region,traffic\nA,North,10\nB,South,20\nC,North,30\n")
    assert load_csv(store, str(tmp_path / "kpi.csv"), "kpi").row_count == 3
    totals = store.read("kpi").groupBy("region").agg(F.sum("traffic"))
    assert rows_of(totals) == [("North", 40), ("South", 20)]


def test_retention_drops_days_and_rewrites_the_edge(spark, store):
    load_frame(store, "t", hourly(spark, 10), "append", watermark=WatermarkSpec("ts"))
    before = {p.path for p in store.manifest("t").parts}
    head = apply_retention(store, "t", Retention(window_days=3), datetime(2024, 1, 10, 12))
    rows = store.read("t").agg(F.min("ts"), F.count("*")).first()
    assert rows[0] == datetime(2024, 1, 7, 12) and rows[1] == 84 == head.row_count
    fresh = [p for p in head.parts if p.path not in before]
    assert [p.place for p in fresh] == [("2024-01-07",)]
    assert store.read("t", 1).count() == 240
    assert apply_retention(store, "t", Retention("keep_forever"), datetime(2030, 1, 1)).version == head.version


def test_retention_without_a_day_layout(spark, store):
    load_frame(store, "t", hourly(spark, 4), "full")
    apply_retention(store, "t", Retention(window_days=1), datetime(2024, 1, 4, 23), "ts")
    assert store.read("t").count() == 25


def test_compaction_merges_segments(spark, store):
    for i in range(3):
        load_frame(store, "t", hourly(spark, 2, cell=f"C{i}"), "append", watermark=WatermarkSpec("ts"))
        load_frame(store, "flat", spark.range(5), "append")
    assert len(store.manifest("t").parts) == 6
    rows = rows_of(store.read("t"))
    assert len(compact(store, "t").parts) == 2 and rows_of(store.read("t")) == rows
    assert compact(store, "t").version == 4  # nothing left to do
    assert len(compact(store, "flat", sort_by=("id",)).parts) == 1 and store.read("flat").count() == 15
    again = compact(store, "t", Layout(buckets=2, keys=("cell",)))
    assert again.layout.buckets == 2 and rows_of(store.read("t")) == rows


def test_rebuild_follows_the_load_order(spark, store):
    load_frame(store, "t", cells(spark, ("A", 1, 0.0), ("Z", 9, 9.0)), "append", run_id="a")
    load_frame(store, "t", cells(spark, ("A", 1, 1.0), ("B", 1, 2.0)), "full", run_id="b")
    load_frame(store, "t", cells(spark, ("B", 1, 3.0), ("C", 1, 4.0), (None, 1, 5.0)), "upsert", KEYS, run_id="c")
    load_frame(store, "t", cells(spark, ("C", 1, 6.0), ("C", 1, 7.0), (None, 1, 5.0)), "upsert", KEYS, run_id="d")
    load_frame(store, "t", cells(spark, ("C", 1, 8.0)), "append", run_id="e")
    load_frame(store, "t", cells(spark, ("C", 1, 9.0), ("A", 1, 9.5)), "upsert", KEYS, run_id="f")
    want = rows_of(store.read("t"))
    rebuild(store, "t", into="again")
    assert rows_of(store.read("again")) == want
    rebuild(store, "t")
    assert rows_of(store.read("t")) == want


def test_rebuild_after_restore_and_expiry(spark, store, tmp_path):
    for n in (3, 4):
        load_frame(store, "t", spark.range(n), "append")
    export_snapshot(store, str(tmp_path / "snap"))
    import_snapshot(store, str(tmp_path / "snap"))
    load_frame(store, "t", spark.range(5), "append")
    assert rebuild(store, "t").row_count == 12
    for n in (1, 2, 3):
        load_frame(store, "plain", spark.range(n), "append")
    assert expire_versions(store, "plain", keep=1) == []  # they are the only record for a rebuild
    assert rebuild(store, "plain").row_count == 6
    assert expire_versions(store, "plain", keep=1) == [1, 2, 3]
    assert rebuild(store, "plain").row_count == 6
    load_frame(store, "gone", spark.range(2), "append", watermark=None)
    store.files.remove(store.manifest("gone").landing_path)
    with pytest.raises(LookupError, match="gone"):
        rebuild(store, "gone")


def test_snapshot_round_trip(spark, store, tmp_path):
    load_frame(store, "a", hourly(spark, 2), "append", watermark=WatermarkSpec("ts"))
    load_frame(store, "b", spark.range(3), "full")
    assert export_snapshot(store, str(tmp_path / "snap")) == ["a", "b"]
    other = TableStore(spark, str(tmp_path / "other"))
    import_snapshot(other, str(tmp_path / "snap"))
    for name in ("a", "b"):
        assert rows_of(other.read(name)) == rows_of(store.read(name))
    assert other.manifest("a").watermark_value == store.manifest("a").watermark_value
    assert other.manifest("a").layout.day == "ts"


def test_expiry_spares_what_versions_use(spark, store):
    load_frame(store, "flat", spark.range(3), "full")  # the landing directory is the table
    load_frame(store, "days", hourly(spark, 1), "append", watermark=WatermarkSpec("ts"))
    later = datetime.now() + timedelta(days=31)
    assert expire_landing(store, "flat", later) == []
    assert expire_landing(store, "days", datetime.now()) == []
    assert len(expire_landing(store, "days", later)) == 1
    assert store.read("flat").count() == 3 and store.read("days").count() == 24


def test_version_expiry_deletes_only_orphans(spark, store):
    for n in (1, 2):
        load_frame(store, "t", spark.range(n), "append")
    load_frame(store, "t", spark.range(7), "full")
    assert expire_versions(store, "t", keep=2) == [1]
    assert store.read("t", 2).count() == 3 and store.read("t").count() == 7


def test_exports(spark, store, tmp_path):
    load_frame(store, "t", cells(spark, ("A", 1, 1.5)), "full")
    for kind in ("parquet", "json", "orc", "csv"):
        export_table(store, "t", str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().cell_id == "A"
    with pytest.raises(SpecError):
        export_table(store, "t", "x", "xml")


def test_latest_per_key(spark):
    df = cells(spark, ("A", 1, 1.0), ("A", 3, 2.0), ("B", None, 5.0), ("B", None, 4.0))
    assert [r[:2] for r in rows_of(latest_per_key(df, ["cell_id"], "ts"))] == [("A", 3), ("B", None)]


def test_time_limit_cancels(spark, store):
    with pytest.raises(Exception), time_limit(store, 1, "slow"):  # noqa: B017
        spark.range(8).select(F.call_function("java_method", F.lit("java.lang.Thread"), F.lit("sleep"), F.lit(20000).cast("bigint"))).collect()
    assert loads.COMMIT_TRIES > 1
    assert spark.range(3).count() == 3


def test_retries_wait_longer_and_keep_one_result(spark, store, tmp_path, monkeypatch):
    path = str(tmp_path / "in")
    spark.createDataFrame([(i,) for i in range(5)], "n int").write.option("header", True).csv(path)
    job = JobSpec("r", JobSource("csv", upload_id="u"), "t", Schedule(every="1h"), "append", WatermarkSpec("n", "integer"))
    around = Surroundings(uploads={"u": path})
    real, failures, waits = TableStore.commit, [OSError("a"), OSError("b")], []

    def commit(self, manifest):
        if failures:
            raise failures.pop()
        return real(self, manifest)

    monkeypatch.setattr(TableStore, "commit", commit)
    result = run_job_retrying(store, job, around, sleep=waits.append, longest_wait_s=1.5)
    assert result.row_count == 5 and waits == [1.0, 1.5]
    assert [(r.attempt, r.status) for r in run_log(store).orderBy("attempt").collect()] == [
        (1, "failed"), (2, "failed"), (3, "success"),
    ]

    def commit_then_fail(self, manifest):
        real(self, manifest)
        raise OSError("answer lost")

    monkeypatch.setattr(TableStore, "commit", commit_then_fail)
    spark.createDataFrame([(9,)], "n int").write.mode("append").option("header", True).csv(path)
    assert run_job_retrying(store, job, around, sleep=waits.append).row_count == 6
    assert store.read("t").count() == 6
    with pytest.raises(LookupError):
        run_job_retrying(store, job, Surroundings(), sleep=waits.append)


def test_rows_can_be_grouped_before_landing(spark, store, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("N", 1), ("N", 3), ("S", 5)], "region string, v int").write.option("header", True).csv(path)
    grouping = {"groupBy": ["region"], "aggregations": [{"fn": "sum", "col": "v", "as": "total"}]}
    source = JobSource("csv", upload_id="u", filters=(Filter("v", ">", 1),), options=grouping)
    run_job(store, JobSpec("g", source, "t", Schedule(every="1h"), "full"), Surroundings(uploads={"u": path}))
    assert [(r.region, int(r.total)) for r in store.read("t").orderBy("region").collect()] == [("N", 3), ("S", 5)]


def test_upsert_by_other_keys_spreads_the_table_anew(spark, store):
    mark = WatermarkSpec("ts")
    load_frame(store, "t", hourly(spark, 3), "full", watermark=mark)
    assert store.manifest("t").layout == Layout(day="ts")
    # The day is part of the new key: the layout still serves.
    load_frame(store, "t", hourly(spark, 1).withColumn("v", F.lit(-1.0)), "upsert", ("cell", "ts"), mark)
    assert store.manifest("t").layout == Layout(day="ts") and store.read("t").count() == 72
    # A key without the day may match rows of any day.
    one = hourly(spark, 1, start=datetime(2024, 6, 1)).limit(1)
    load_frame(store, "t", one, "upsert", ("cell",), mark)
    assert store.manifest("t").layout.columns == [] and store.read("t").count() == 1


def test_days_do_not_depend_on_the_session_zone(spark, store):
    make = lambda: hourly(spark, 2).withColumn("ts", F.timestamp_micros(F.unix_micros(F.lit("2024-01-01T00:00:00Z").cast("timestamp")) + F.col("v").cast("bigint") * 3_600_000_000))
    mark = WatermarkSpec("ts")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            load_frame(store, "t", make(), "upsert", ("cell", "ts"), mark)
            assert store.manifest("t").row_count == 48
            assert sorted(p.place for p in store.manifest("t").parts) == [("2024-01-01",), ("2024-01-02",)]
            first = store.query(QuerySpec("t", filters=(Filter("ts", "<", "2024-01-01T06:00:00Z"),))).rows
            assert first.count() == 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
