from __future__ import annotations

import pytest

from kpiweave.specs import (
    Aggregation,
    Dashboard,
    Filter,
    JobSource,
    JobSpec,
    LoadCommand,
    QuerySpec,
    Schedule,
    SpecError,
    WatermarkSpec,
    Widget,
    complete_query,
)


@pytest.mark.parametrize("name", ['a"; DROP TABLE x;--', "a b", "1col", "a)", "", "x" * 129, None])
def test_hostile_names_are_rejected(name):
    with pytest.raises(SpecError):
        QuerySpec("t", columns=(name,))
    with pytest.raises(SpecError):
        Filter(name, "=", 1)


@pytest.mark.parametrize("name", ["_a", "A1$#", "x" * 128])
def test_plain_names_pass(name):
    assert QuerySpec("t", columns=(name,)).columns == (name,)


def test_query_round_trip():
    wire = {
        "table": "t",
        "columns": ["a"],
        "aggregations": [{"fn": "AVG", "col": "x", "as": "m"}, {"fn": "count", "col": None, "as": "n"}],
        "groupBy": ["b"],
        "filters": [{"col": "c", "op": "between", "value": [1, 9]}],
        "sort": [{"col": "m", "dir": "DESC"}],
        "limit": 5,
        "page": 2,
        "table_version_pin": 3,
        "include_sql": True,
    }
    spec = QuerySpec.from_json(wire)
    assert spec.aggregations[0].fn == "avg" and spec.sort[0].dir == "desc" and spec.offset == 5
    assert QuerySpec.from_json(spec.to_json()) == spec


@pytest.mark.parametrize(
    "change",
    [
        {"limit": 0},
        {"limit": 100_001},
        {"page": 0},
        {"table_version_pin": 0},
        {"aggregations": [{"fn": "mode", "col": "x", "as": "m"}]},
        {"aggregations": [{"fn": "sum", "as": "m"}]},
        {"aggregations": [{"fn": "sum", "col": "x", "as": "m"}, {"fn": "avg", "col": "x", "as": "M"}]},
        {"columns": ["a", "A"]},
        {"filters": [{"col": "c", "op": "~", "value": 1}]},
        {"filters": [{"col": "c", "op": "between", "value": [1]}]},
        {"filters": [{"col": "c", "op": "in", "value": "abc"}]},
        {"sort": [{"col": "c", "dir": "up"}]},
    ],
)
def test_bad_queries(change):
    with pytest.raises(SpecError):
        QuerySpec.from_json({"table": "t", **change})


def test_defaults():
    spec = QuerySpec("t")
    assert (spec.limit, spec.page, spec.table_version_pin) == (1000, 1, None)


def _job(**changes):
    values = {
        "name": "j",
        "source": JobSource("connection", table="t", columns=("a",), connection_id=1),
        "target_table": "t",
        "schedule": Schedule(every="1h"),
        "load_mode": "upsert",
        "key_columns": ("a",),
        "watermark": WatermarkSpec("ts", "integer"),
        **changes,
    }
    return JobSpec(**values)


def test_job_round_trip_keeps_the_watermark_type():
    job = _job()
    again = JobSpec.from_json(job.to_json())
    assert again == job
    assert again.watermark.type == "integer"
    assert (again.guards.row_cap, again.guards.timeout_s, again.retention.window_days) == (None, None, 395)


@pytest.mark.parametrize(
    "build",
    [
        lambda: _job(key_columns=()),
        lambda: _job(watermark=None),
        lambda: _job(watermark=None, load_mode="append"),
        lambda: Schedule(),
        lambda: JobSource("connection", table="t", columns=("a",)),
        lambda: JobSource("connection", connection_id=1, mode="raw"),
        lambda: JobSource("oracle", table="t"),
        lambda: JobSource("csv"),
        lambda: JobSource("duckdb_query"),
        lambda: JobSource("ftp"),
        lambda: WatermarkSpec("ts", "text"),
        lambda: LoadCommand("r", "t", "full"),
        lambda: LoadCommand("r", "t", "full", "p", "SELECT 1"),
        lambda: LoadCommand("r", "t", "upsert", "p"),
    ],
)
def test_incoherent_jobs(build):
    with pytest.raises(SpecError):
        build()


def test_default_load_mode_is_upsert():
    with pytest.raises(SpecError):
        JobSpec("j", JobSource("csv", upload_id="u"), "t", Schedule(every="1d"))
    assert _job(load_mode="full", watermark=None, key_columns=()).load_mode == "full"


def test_half_filled_queries_are_completed():
    query = {
        "aggregations": [{"fn": "sum", "as": "x"}, {"fn": "count", "as": "n"}, {"fn": "avg", "col": "a"}, {}],
        "sort": [{"dir": "asc"}, {"col": "n"}],
    }
    cleaned = complete_query(query)
    assert cleaned["aggregations"] == [{"fn": "count", "as": "n"}]
    assert cleaned["sort"] == [{"col": "n"}]


def test_dashboard_round_trip_and_pins():
    wire = {
        "widgets": [
            {"id": "a", "type": "kpi", "source": {"table": "t", "table_version_pin": 4}, "query": {"table": "other"}},
            {"id": "b", "type": "map", "source": {"table": "u"}, "query": {}, "grid": {"w": 3}},
        ]
    }
    board = Dashboard.from_json(wire)
    assert board.widgets[0].query.table == "t" and board.widgets[0].query.table_version_pin == 4
    assert board.widgets[1].grid == {"x": 0, "y": 0, "w": 3, "h": 6}
    assert Dashboard.from_json(board.to_json()) == board
    with pytest.raises(SpecError):
        Dashboard((board.widgets[0], board.widgets[0]))
    with pytest.raises(SpecError):
        Widget("x", "gauge", QuerySpec("t"))
    assert Aggregation("count", None, "n").to_json() == {"fn": "count", "col": None, "as": "n"}


def test_load_command_round_trip():
    command = LoadCommand("r", "t", "upsert", "p", None, ("a",), WatermarkSpec("n", "integer"), "7", 3, "j")
    assert LoadCommand.from_json(command.to_json()) == command
