from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kpiweave.functions.timing import interval_column, interval_seconds, is_stale, stale_column
from kpiweave.plans.catalog import (
    catalog,
    job_metrics,
    newest_runs,
    overdue,
    refresh_rollup,
    registry,
    result_key,
    stalled_marks,
    table_detail,
)
from kpiweave.plans.dashboard import (
    cascaded,
    effective_viz,
    kpi_text,
    map_cells,
    map_points,
    pivot_series,
    run_dashboard,
    shape,
    shares,
)
from kpiweave.plans.loads import load_frame, run_job
from kpiweave.plans.runs import run_log
from kpiweave.plans.store import utc_now
from kpiweave.sources.registry import Surroundings
from kpiweave.specs import Dashboard, Filter, JobSource, JobSpec, QuerySpec, Schedule, Widget

from .conftest import rows_of


@pytest.mark.parametrize(
    "every,seconds",
    [("15m", 900), (" 2 h ", 7200), ("1d", 86400), ("30s", 30), ("0 * * * *", 3600), (None, 3600), ("1w", 3600), ("h", 3600)],
)
def test_intervals(spark, every, seconds):
    assert interval_seconds(every) == seconds
    frame = spark.createDataFrame([(every,)], "every string").select(interval_column(F.col("every")))
    assert frame.first()[0] == seconds


def test_staleness_is_strict(spark):
    now = datetime(2024, 1, 1, 12)
    cases = [(None, True), (now - timedelta(hours=2), False), (now - timedelta(hours=2, microseconds=1), True), (now, False)]
    for moment, stale in cases:
        assert is_stale(moment, 3600, now) == stale
        frame = spark.createDataFrame([(moment, now)], "m timestamp_ntz, n timestamp_ntz")
        assert frame.select(stale_column(F.col("m"), F.lit(3600), F.col("n"))).first()[0] == stale


def _job(name, table, every="1h"):
    return JobSpec(name, JobSource("csv", upload_id="u"), table, Schedule(every=every), "full")


def test_catalog_shows_latest_versions(spark, store):
    assert catalog(store, [], datetime.now()).count() == 0
    for n in (1, 2):
        load_frame(store, "b", spark.range(n), "full")
    load_frame(store, "a", spark.range(5), "full")
    rows = catalog(store, [_job("jb", "b", "1d")], utc_now() + timedelta(hours=5)).collect()
    assert [(r.table_name, r.row_count, r.table_version, r.interval_s, r.stale) for r in rows] == [
        ("a", 5, 1, 3600, True),
        ("b", 2, 2, 86400, False),
    ]
    assert registry(store).count() == 3
    detail = table_detail(store, "a", sample=True)
    assert detail["columns"] == [{"name": "id", "type": "bigint"}] and detail["sample"].count() == 5


def test_run_reports(spark, store):
    for n in range(4):
        load_frame(store, "t", spark.range(n + 1), "append", job_name="j")
    with pytest.raises(ValueError):
        load_frame(store, "t", spark.createDataFrame([("x",)], "other string"), "append", job_name="j")
    runs = run_log(store)
    assert newest_runs(runs, "job_name", "run_id", 2).count() == 2
    now = F.lit((utc_now() + timedelta(hours=3)).isoformat(sep=" ")).cast("timestamp_ntz")
    row = job_metrics(runs, now).first()
    assert (row.runs, row.succeeded, row.failed, row.rows_written) == (5, 4, 1, 10)
    schedules = spark.createDataFrame([("j", "1h")], "job_name string, every string")
    assert overdue(job_metrics(runs, now), schedules).count() == 1
    assert overdue(job_metrics(runs, now), schedules.withColumn("every", F.lit("2h"))).count() == 0


def test_stalled_marks(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "y"), ("a", 4, "y"), ("b", 1, "p"), ("b", 2, "p"), ("b", 3, "q")]
    runs = spark.createDataFrame(rows, "job string, at int, mark string")
    assert rows_of(stalled_marks(runs, "job", "mark", "at")) == [("a", "y", 3)]


def test_rollup_is_rebuilt_only_for_a_new_version(spark, store):
    spec = QuerySpec.from_json({"table": "t", "groupBy": ["k"], "aggregations": [{"fn": "count", "as": "n"}]})
    frame = spark.range(6).select((F.col("id") % 2).alias("k"))
    load_frame(store, "t", frame, "full")
    assert [refresh_rollup(store, "r", spec)[1] for _ in range(2)] == [True, False]
    load_frame(store, "t", frame, "append")
    head, rebuilt = refresh_rollup(store, "r", spec)
    assert rebuilt and rows_of(store.read("r")) == [(0, 6), (1, 6)] and head.inputs == {"t": 2}
    assert result_key(spec, 1) != result_key(spec, 2)
    echo = QuerySpec.from_json({**spec.to_json(), "include_sql": True})
    assert result_key(spec, 1) == result_key(echo, 1)


def _widget(kind, query, viz=None):
    return Widget.from_json({"id": "w", "type": kind, "source": {"table": "t"}, "query": query, "viz": viz or {}})


def test_viz_defaults():
    grouped = _widget("line", {"groupBy": ["h", "r"], "aggregations": [{"fn": "avg", "col": "v", "as": "m"}]})
    assert effective_viz(grouped) == {"value": "m", "x": "h", "y": "m", "series": "r"}
    plain = _widget("scatter", {"columns": ["a", "b"]}, {"unit": "%"})
    assert effective_viz(plain) == {"unit": "%", "value": "value", "x": "a", "y": "b", "series": None}
    given = _widget("bar", {"groupBy": ["h", "r"], "aggregations": [{"fn": "count", "as": "n"}]}, {"x": "r", "series": ""})
    assert effective_viz(given)["x"] == "r" and effective_viz(given)["series"] == ""


def test_pivot_keeps_the_last_duplicate_and_names_null(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, None, 3.0), (2, "b", 4.0)], "x int, s string, y double").coalesce(1)
    frame = pivot_series(rows, "x", "s", "y")
    assert frame.columns == ["x", "a", "null", "b"]  # as the rows first name them
    assert [tuple(r) for r in frame.collect()] == [(1, 2.0, 3.0, None), (2, None, None, 4.0)]


def test_shapes(spark):
    rows = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    table = _widget("table", {"columns": ["k", "v"]})
    assert shape(table, rows).count() == 200
    bar = _widget("bar", {"groupBy": ["k"], "aggregations": [{"fn": "sum", "col": "v", "as": "v"}]})
    assert shape(bar, rows).columns == ["k", "v"]
    kpi = _widget("kpi", {"aggregations": [{"fn": "avg", "col": "v", "as": "value"}]})
    assert shape(kpi, spark.createDataFrame([(float("nan"),)], "value double")).first()[0] is None
    assert shape(kpi, spark.createDataFrame([("x",)], "value string")).first()[0] is None
    assert shape(kpi, spark.createDataFrame([(7,)], "value int")).first()[0] == 7.0


def test_kpi_text_and_shares(spark):
    assert kpi_text(None) == "—" and kpi_text(float("nan")) == "—"
    assert kpi_text(1234.5) == "1,234.5" and kpi_text(1234.567, 0) == "1,235" and kpi_text(0.12345, 3) == "0.123"
    frame = shares(spark.createDataFrame([("a", 1), ("b", 3)], "k string, v int"), "v")
    assert rows_of(frame) == [("a", 1, 0.25), ("b", 3, 0.75)]


def test_maps(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 5), (1.4, 2.2, 7), (-0.1, 2.0, 1), (None, 1.0, 9), (50.0, 2.0, 2)], "lat double, lon double, w int")
    assert map_points(rows, {"weight": "w", "tooltip": ["w", "lat"]}).columns == ["lat", "lon", "w"]
    assert map_points(rows, {}).count() == 4
    cells = rows_of(map_cells(rows, "lat", "lon", 0.5, "w", (-1, 0, 10, 10)))
    assert cells == [(-1, 4, 1, 1), (2, 4, 2, 12)]


def test_dashboard_with_shared_filters(spark, store):
    load_frame(store, "t", spark.createDataFrame([("N", 1.0), ("N", 3.0), ("S", 5.0)], "region string, v double"), "full")
    load_frame(store, "u", spark.range(4), "full")
    total = {"aggregations": [{"fn": "sum", "col": "v", "as": "value"}]}
    count = {"aggregations": [{"fn": "count", "as": "value"}]}
    board = Dashboard.from_json(
        {
            "widgets": [
                {"id": "a", "type": "kpi", "source": {"table": "t"}, "query": total},
                {"id": "b", "type": "kpi", "source": {"table": "u"}, "query": count},
            ]
        }
    )
    shown = run_dashboard(store, board, [Filter("REGION", "=", "N")])
    assert shown["a"].data.first()[0] == 4.0 and shown["b"].data.first()[0] == 4.0
    assert "WHERE" in shown["a"].result.sql and "WHERE" not in shown["b"].result.sql
    spec = QuerySpec("t")
    assert cascaded(spec, [Filter("zz", "=", 1)], ["region"]) is spec
