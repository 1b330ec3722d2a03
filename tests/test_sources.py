from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from kpiweave.operators.incremental import capped, since
from kpiweave.sources import jdbc
from kpiweave.sources.csv_files import infer_csv, read_csv, suggested_table
from kpiweave.sources.landing import land
from kpiweave.sources.registry import Surroundings, infer_frame, preview_source, profile, read_source, validate_source
from kpiweave.sources.sqlguard import GuardError, check_select
from kpiweave.sources.synthetic import hour_range, read_synthetic
from kpiweave.specs import Filter, Guards, JobSource, JobSpec, Schedule, SpecError, WatermarkSpec

from .conftest import rows_of


def written(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize(
    "text,delimiter,types",
    [
        ("cell_id,traffic,region\nA,1.5,North\nB,,South\nC,3,East\n", ",", ["string", "double", "string"]),
        ("a;b\n1;2\n3;4\n", ";", ["bigint", "bigint"]),
        ("a\tb\n1\tx\n", "\t", ["bigint", "string"]),
        ("a|b\n1.5|TRUE\n2|no\n", "|", ["double", "boolean"]),
        ("a,b\n007,1\n008,2\n", ",", ["string", "bigint"]),
        ("a,b\n13/02/2024,x\n01/02/2024,y\n", ",", ["date", "string"]),
        ("a,b\n02/13/2024,x\n", ",", ["date", "string"]),
        ("a,b\n12:30:00,1\n", ",", ["string", "bigint"]),
        ("a,b\n2024-01-02T03:04:05Z,1\n", ",", ["timestamp", "bigint"]),
        ("a,b\n2024-01-02 03:04:05.25,1\n", ",", ["timestamp_ntz", "bigint"]),
        ("a,b\n,1\n,2\n", ",", ["string", "bigint"]),
        ("a,b\n99999999999999999999,nan\n", ",", ["decimal(38,0)", "double"]),
        ("a,b\n+1,y\n2,n\n", ",", ["string", "string"]),
    ],
)
def test_inference(spark, tmp_path, text, delimiter, types):
    schema = infer_csv(spark, written(tmp_path, text))
    assert schema.delimiter == delimiter and schema.has_header
    assert [c.type for c in schema.columns] == types
    assert schema.row_estimate == text.count("\n") - 1


def test_first_fixture(spark, tmp_path):
    schema = infer_csv(spark, written(tmp_path, "cell_id,traffic,region\nA,1.5,North\nB,,South\nC,3,East\n"))
    assert [c.nulls for c in schema.columns] == [0, 1, 0]
    assert schema.sample_rows[1] == {"cell_id": "B", "traffic": None, "region": "South"}


def test_headers(spark, tmp_path):
    names = lambda text: [c.name for c in infer_csv(spark, written(tmp_path, text)).columns]
    assert names("1,2\n3,4\n") == ["column0", "column1"]
    assert names("x,1\ny,2\n") == ["column0", "column1"]
    assert names("a,b\nc,d\n") == ["a", "b"]
    assert names("a,a,\n1,2,3\n") == ["a", "a_1", "column2"]
    assert names("n a,b\n1,2\n") == ["n a", "b"]


def test_quotes_and_lines_inside_quotes(spark, tmp_path):
    rows = rows_of(read_csv(spark, written(tmp_path, 'a,b\n"x\ny",1\n"z ""q"", w",2\n')))
    assert rows == [("x\ny", 1), ('z "q", w', 2)]


def test_types_can_be_corrected(spark, tmp_path):
    path = written(tmp_path, "a,b\n1,2024-01-02\n2,2024-01-03\n")
    frame = read_csv(spark, path, types={"a": "string", "b": "timestamp_ntz"})
    assert rows_of(frame) == [("1", datetime(2024, 1, 2)), ("2", datetime(2024, 1, 3))] or frame.schema["a"].dataType.simpleString() == "string"
    assert rows_of(read_csv(spark, path)) == [(1, date(2024, 1, 2)), (2, date(2024, 1, 3))]
    with pytest.raises(SpecError):
        read_csv(spark, path, types={"zz": "int"})
    assert read_csv(spark, path, ["B"]).columns == ["b"]


def test_many_files_tell_their_origin(spark, tmp_path):
    a, b = written(tmp_path, "x,y\n1,2\n", "a.csv"), written(tmp_path, "x,y\n3,4\n", "b.csv")
    assert rows_of(read_csv(spark, [a, b], with_file=True)) == [(1, 2, "a.csv"), (3, 4, "b.csv")]
    assert read_csv(spark, str(tmp_path / "*.csv")).count() == 2


def test_table_names_from_file_names():
    assert suggested_table("CS Cell 2024.csv") == "cs_cell_2024"
    assert suggested_table("3g-kpi.csv") == "t_3g_kpi"
    assert suggested_table("C:\\data\\Kpi.CSV") == "kpi"
    assert suggested_table("---.csv") == "dataset"


def test_landing_counts_and_marks(spark, tmp_path):
    df = spark.createDataFrame([(9, "a"), (10, "b"), (None, "c")], "n int, s string")
    assert land(df, str(tmp_path / "1"), "N").new_watermark == "10"
    empty = land(df.filter("n > 99"), str(tmp_path / "2"), "n", "7")
    assert (empty.rows_read, empty.new_watermark) == (0, "7")
    nulls = land(df.filter("n is null"), str(tmp_path / "3"), "n", "7")
    assert (nulls.rows_read, nulls.new_watermark) == (1, "7")
    assert spark.read.parquet(str(tmp_path / "2")).columns == ["n", "s"]


def test_marks_compare_by_type_and_lag_reads_again(spark):
    df = spark.createDataFrame([(8,), (9,), (10,)], "n int")
    assert rows_of(since(df, "n", "9")) == [(10,)]
    assert since(df, "n", None).count() == 3
    times = spark.createDataFrame([(datetime(2024, 1, 1, h),) for h in range(5)], "ts timestamp_ntz")
    assert since(times, "ts", "2024-01-01T03:00:00").count() == 1
    assert since(times, "ts", "2024-01-01T03:00:00", lag="2 hours").count() == 3


def test_a_cap_needs_a_mark(spark):
    df = spark.range(10)
    assert capped(df, None, None).count() == 10
    with pytest.raises(SpecError, match="row cap"):
        capped(df, None, 4)
    assert capped(df, "id", 4).count() == 4 and capped(df, "id", 10).count() == 10


def test_synthetic_window(spark):
    noon = datetime(2024, 1, 3, 12, 30)
    assert hour_range(noon) == (datetime(2024, 1, 1, 12), 49)
    assert hour_range(noon, "2024-01-03T10:00:00") == (datetime(2024, 1, 3, 11), 2)
    assert hour_range(noon, "2024-01-03T12:00:00")[1] == 0
    frame = read_synthetic(spark, ["cell_id", "region", "traffic_erl", "drop_rate", "site_id", "other"], noon)
    assert frame.columns[0] == "timestamp" and frame.count() == 588
    assert frame.schema["site_id"].dataType.simpleString() == "string"
    assert frame.select("cell_id").distinct().count() == 12
    means = {r.region: r.m for r in frame.groupBy("region").agg(F.avg("traffic_erl").alias("m")).collect()}
    assert all(abs(means[k] - v) < v * 0.1 for k, v in {"North": 42, "South": 31, "East": 26, "West": 37}.items())
    assert rows_of(frame) == rows_of(read_synthetic(spark, frame.columns[1:], noon))


# --- databases: options and pushed operations, without a database ---------------------------

URL = {"url": "jdbc:postgresql://host/db", "user": "u"}
SOURCE = JobSource("connection", schema="son", table="cells", columns=("ID", "v"), filters=(Filter("v", ">", 1),), connection_id=1)


def test_structured_options():
    options = jdbc.table_options(URL, SOURCE, Guards(timeout_s=30))
    assert options["dbtable"] == "son.cells" and options["queryTimeout"] == "30" and options["fetchsize"] == "10000"
    split = JobSource("connection", table="t", columns=("a",), connection_id=1, options={"numPartitions": 8, "partitionColumn": "a"})
    assert jdbc.table_options(URL, split)["numPartitions"] == "8"
    with pytest.raises(SpecError):
        jdbc.table_options(URL, JobSource("connection", table="t; DROP", columns=("a",), connection_id=1))


def test_raw_options(spark):
    raw = JobSource("connection", mode="raw", raw_sql="SELECT a FROM son.t WHERE a > :watermark;", connection_id=1)
    make = lambda mark, kind="timestamp": jdbc.query_options(spark, URL, raw, WatermarkSpec("a", kind), mark)["query"]
    assert make(None).endswith("a > NULL")
    assert make("2024-01-02T03:04:05").endswith("a > TIMESTAMP '2024-01-02 03:04:05'")
    assert make("2024-01-02").endswith("TIMESTAMP '2024-01-02 00:00:00'")
    assert make("17", "integer").endswith("a > 17")
    for mark, kind in (("1 OR 1=1", "integer"), ("x' OR '1'='1", "timestamp")):
        with pytest.raises(SpecError):
            make(mark, kind)
    guarded = {**URL, "allowed_schemas": ["other"]}
    with pytest.raises(GuardError):
        jdbc.query_options(spark, guarded, raw, None, "1")
    with pytest.raises(GuardError):
        jdbc.query_options(spark, URL, JobSource("connection", mode="raw", raw_sql="DELETE FROM t", connection_id=1), None, None)


def test_structured_extract_applies_filters_mark_and_columns(spark):
    table = spark.createDataFrame([(1, 0.5, 1), (2, 2.5, 2), (3, 3.5, 3)], "id int, v double, ts int")
    seen = {}

    def loader(_, options):
        seen.update(options)
        return table

    frame = jdbc.read_jdbc(spark, URL, SOURCE, WatermarkSpec("ts", "integer"), "2", None, loader)
    assert rows_of(frame) == [(3, 3.5)] and seen["dbtable"] == "son.cells"
    oracle = JobSource("oracle", schema="SON", table="t", columns=("ID", "V"))
    upper = lambda *_: table.toDF("ID", "V", "TS")
    assert jdbc.read_jdbc(spark, URL, oracle, loader=upper).columns == ["id", "v"]
    with pytest.raises(SpecError):
        jdbc.read_jdbc(spark, {**URL, "allowed_schemas": ["x"]}, oracle, loader=upper)
    assert jdbc.legacy_numeric(table).schema["id"].dataType.simpleString() == "double"


def test_table_listing(spark):
    listing = spark.createDataFrame([("B", "t2"), ("A", "t1"), ("A", "t0")], "TABLE_SCHEMA string, TABLE_NAME string")
    frame = jdbc.list_tables(spark, URL, "a", lambda *_: listing)
    assert [tuple(r) for r in frame.collect()] == [("A", "t0"), ("A", "t1")]
    assert "all_tables" in jdbc.tables_query({"url": "jdbc:oracle:thin:@h"})["query"]
    assert "information_schema" in jdbc.tables_query(URL)["query"]
    with pytest.raises(SpecError):
        jdbc.database_kind({"url": "http://x"})


# --- jobs -----------------------------------------------------------------------------------


def _job(source, **changes):
    return JobSpec(**{"name": "j", "source": source, "target_table": "t", "schedule": Schedule(every="1h"), "load_mode": "full", **changes})


def test_preview_and_validation(spark, tmp_path):
    path = written(tmp_path, "a,b\n" + "".join(f"{i},x\n" for i in range(50)))
    around = Surroundings(uploads={"u": path}, connections={1: URL}, as_of=datetime(2024, 1, 1))
    job = _job(JobSource("csv", upload_id="u", columns=("a",)))
    assert preview_source(spark, job, around).count() == 20
    assert validate_source(spark, job, around).columns == ("a",)
    select = _job(JobSource("duckdb_query", transform_sql="SELECT 1;"))
    assert validate_source(spark, select, around).rendered_sql == "SELECT 1"
    with pytest.raises(GuardError):
        validate_source(spark, _job(JobSource("duckdb_query", transform_sql="DROP TABLE x")), around)
    assert "son.cells" in validate_source(spark, _job(SOURCE), around).rendered_sql
    generated = _job(JobSource("synthetic", columns=("cell_id", "drop_rate")))
    assert validate_source(spark, generated, around).columns == ("timestamp", "cell_id", "drop_rate")
    with pytest.raises(LookupError):
        validate_source(spark, _job(JobSource("oracle", table="t", columns=("cell_id",))), around)
    with pytest.raises(SpecError):
        read_source(spark, select, around)
    with pytest.raises(LookupError):
        read_source(spark, _job(JobSource("csv", upload_id="zz")), around)


def test_profile_and_frame_inference(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert rows_of(profile(df)) == [("a", "int", 2, 0, "1", "2"), ("b", "string", 2, 1, "b", "b")]
    schema = infer_frame(df)
    assert [c.type for c in schema.columns] == ["int", "string"] and len(schema.sample_rows) == 2


# --- guard ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "sql",
    [
        "DELETE FROM t",
        "SELECT 1; DROP TABLE x",
        "UPDATE t SET a = 1",
        "INSERT INTO t SELECT 1",
        "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
        "FROM t INSERT INTO a SELECT * INSERT INTO b SELECT *",
        "CREATE TABLE x AS SELECT 1",
        "MERGE INTO a USING b ON a.x = b.x WHEN MATCHED THEN DELETE",
        "SET x = 1",
        "SHOW TABLES",
        "BEGIN SELECT 1; END",
        "SELECT TRANSFORM(a) USING 'cat' FROM t",
        "SELECT reflect('java.lang.System', 'exit', 0)",
        "SELECT a FROM t WHERE b = (SELECT java_method('x', 'y'))",
        "",
        "not sql",
    ],
)
def test_guard_rejects(spark, sql):
    with pytest.raises(GuardError):
        check_select(spark, sql)


def test_guard_accepts_and_names_tables(spark):
    sql = 'WITH c AS (SELECT * FROM t) SELECT "x" FROM c JOIN s.u ON 1 = 1 WHERE x IN (SELECT y FROM v) UNION SELECT 1 ;'
    checked = check_select(spark, sql)
    assert set(checked.tables) == {"t", "s.u", "v"} and not checked.text.endswith(";")


def test_guard_schemas_and_bounds(spark):
    assert check_select(spark, "SELECT a FROM SON.t", ["son"]).tables == ("SON.t",)
    for sql in ("SELECT a FROM t", "SELECT a FROM x.t", "SELECT a FROM son.t WHERE b IN (SELECT c FROM x.u)"):
        with pytest.raises(GuardError):
            check_select(spark, sql, ["son"])
    for sql in ("SELECT a FROM t WHERE b > 1", "SELECT a FROM t LIMIT 3", "SELECT a FROM t WHERE x = 1 UNION SELECT b FROM u LIMIT 3"):
        try:
            check_select(spark, sql, bounded=True)
        except GuardError:
            # A limit over the whole union does not bound its branches' reads.
            assert "UNION" in sql
    for sql in ("SELECT a FROM t", "SELECT a FROM t WHERE x = 1 UNION ALL SELECT b FROM u", "SELECT * FROM (SELECT * FROM t WHERE a = 1) q"):
        with pytest.raises(GuardError):
            check_select(spark, sql, bounded=True)


# --- files that do not fit ----------------------------------------------------------------------


@pytest.mark.parametrize("text", ["a,b\n1,2\n3\n4,5,6\n", "a,b\n1,2\n4,5,6\n"])
def test_ragged_lines_are_errors(spark, tmp_path, text):
    with pytest.raises(Exception, match=r"MALFORMED|FAILFAST|malformed"):
        read_csv(spark, written(tmp_path, text)).collect()


def test_other_headers_are_errors(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n")
    (folder / "2.csv").write_text("b,a\n3,4\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(folder)).collect()


def test_a_late_quoted_line_break(spark, tmp_path):
    rows = [f"{i},x\n" for i in range(299)] + ['299,"two\nlines"\n', "300,y\n"]
    frame = read_csv(spark, written(tmp_path, "n,t\n" + "".join(rows)))
    assert frame.count() == 301 and frame.schema["n"].dataType.simpleString() in ("int", "bigint")


def test_misfits_of_corrected_types_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="b is not"):
        read_csv(spark, written(tmp_path, "a,b\n1,2\n2,x\n"), types={"b": "bigint"}).collect()


def test_a_cte_name_hides_a_table_only_where_it_is_seen(spark):
    sql = "SELECT * FROM secret, (WITH secret AS (SELECT 1 a) SELECT * FROM secret) q"
    assert check_select(spark, sql).tables == ("secret",)
    with pytest.raises(GuardError):
        check_select(spark, sql, allowed_schemas=["son"])
    assert check_select(spark, "WITH a AS (SELECT 1 x), b AS (SELECT * FROM a) SELECT * FROM b").tables == ()


def test_jobs_cannot_replace_the_connection():
    source = JobSource("connection", connection_id=1, table="t", columns=("a",), options={"url": "x", "sessionInitStatement": "y", "numPartitions": 4, "lag": "1 hour"})
    merged = jdbc.table_options(URL, source)
    assert merged["url"] == URL["url"] and merged["numPartitions"] == "4" and not {"sessionInitStatement", "lag"} & set(merged)
