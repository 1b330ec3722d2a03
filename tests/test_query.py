from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpiweave.functions.predicates import where
from kpiweave.operators.query import apply_query, count_total, explain_shape, grouped, query_text
from kpiweave.operators.quantiles import exact_median, key_value, value_at_rank, with_keys
from kpiweave.specs import Aggregation, Filter, QuerySpec, Sort, SpecError

from .conftest import rows_of

ROWS = [
    (1, "a", 1.5, 10, datetime(2024, 1, 1, 0), Decimal("0.01"), True),
    (2, "b", None, 20, datetime(2024, 1, 2, 12), Decimal("0.02"), False),
    (3, None, -2.0, None, datetime(2024, 1, 3), None, None),
    (4, "a", 4.0, 5, None, Decimal("-0.02"), True),
    (5, "b\\x", 4.0, 7, datetime(2024, 1, 2, 13), Decimal("5.00"), False),
    (6, "a%", 0.0, 20, datetime(2023, 12, 31), Decimal("0.04"), True),
]
SCHEMA = "id bigint, name string, x double, n int, ts timestamp_ntz, d decimal(4,2), flag boolean"
DUCK = "id BIGINT, name VARCHAR, x DOUBLE, n INTEGER, ts TIMESTAMP, d DECIMAL(4,2), flag BOOLEAN"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute(f"CREATE TABLE t ({DUCK})")
    connection.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?)", ROWS)
    return connection


def plain(rows):
    def value(v):
        return round(v, 9) if isinstance(v, float) else float(v) if isinstance(v, Decimal) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


names = st.sampled_from(["id", "name", "x", "n", "ts", "flag"])
VALUES = {
    "id": st.integers(0, 7),
    "name": st.sampled_from(["a", "b", "a%", "zz"]),
    "x": st.sampled_from([-2.0, 0.0, 1.5, 4, 3]),
    "n": st.sampled_from([5, 7, 20, "10"]),
    "ts": st.sampled_from(["2024-01-02", "2024-01-02T12:00:00", "2024-01-01 00:00:00"]),
    "flag": st.booleans(),
}


@st.composite
def filters(draw):
    col = draw(names)
    ops = ["=", "!=", ">", ">=", "<", "<=", "in", "not_in", "between", "is_null", "is_not_null"]
    if col == "name":
        ops.append("like")
    op = draw(st.sampled_from(ops))
    value = VALUES[col]
    if op in ("in", "not_in"):
        return Filter(col, op, draw(st.lists(value, max_size=3)))
    if op == "between":
        return Filter(col, op, [draw(value), draw(value)])
    if op == "like":
        return Filter(col, op, draw(st.sampled_from(["a%", "%b%", "_", "b\\%", "%"])))
    if op.startswith("is_"):
        return Filter(col, op)
    return Filter(col, op, draw(value))


aggregations = st.lists(
    st.sampled_from(
        [
            ("sum", "x"), ("sum", "n"), ("avg", "n"), ("avg", "x"), ("min", "name"), ("max", "ts"), ("median", "x"),
            ("median", "n"), ("median", "ts"), ("median", "flag"), ("stddev", "x"), ("count", None), ("count", "x"),
            ("count_distinct", "name"), ("avg", "ts"), ("sum", "flag"), ("median", "d"), ("sum", "d"), ("avg", "d"),
        ]
    ),
    max_size=4,
    unique=True,
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(
    where_=st.lists(filters(), max_size=3),
    aggs=aggregations,
    group=st.lists(st.sampled_from(["name", "flag", "n"]), max_size=2, unique=True),
)
def test_queries_agree_with_their_text(frame, duck, where_, aggs, group):
    spec = QuerySpec(
        "t",
        filters=tuple(where_),
        group_by=tuple(group),
        aggregations=tuple(Aggregation(fn, col, f"o{i}") for i, (fn, col) in enumerate(aggs)),
    )
    text, values = query_text(spec)
    want = duck.execute(text, values).fetchall()
    assert plain(tuple(r) for r in apply_query(frame, spec).collect()) == plain(want)


def test_reference_text_shape():
    spec = QuerySpec(
        "cells",
        aggregations=(Aggregation("avg", "traffic_erl", "m"),),
        group_by=("cell_id",),
        filters=(Filter("region", "in", ["North", "South"]),),
        sort=(Sort("m", "desc"),),
        limit=100,
        page=2,
    )
    text, values = query_text(spec)
    assert values == ["North", "South", 100, 100]
    assert 'avg("traffic_erl") AS "m"' in text and '"region" IN (?, ?)' in text
    other, values = query_text(QuerySpec("t", ("a",), filters=(Filter("ts", "between", [1, 9]), Filter("x", "is_not_null"))))
    assert values[:2] == [1, 9] and '"x" IS NOT NULL' in other


def test_empty_lists_and_nulls_in_lists(frame):
    count = lambda op, value: where(frame, [Filter("n", op, value)]).count()
    assert count("in", []) == 0
    assert count("not_in", []) == len(ROWS)
    assert count("not_in", [5, None]) == 0
    assert count("in", [5, None]) == 1
    assert count("=", None) == 0


def test_literals_bind_by_column_type(frame):
    ids = lambda *f: [r[0] for r in where(frame, f).select("id").orderBy("id").collect()]
    assert ids(Filter("n", ">", 9.5)) == [1, 2, 6]
    assert ids(Filter("n", "=", "20")) == [2, 6]
    assert ids(Filter("ts", ">=", "2024-01-02T12:00:00Z")) == [2, 3, 5]
    assert ids(Filter("ts", "=", datetime(2024, 1, 3))) == [3]
    assert ids(Filter("ts", ">", date(2024, 1, 2))) == [2, 3, 5]
    assert ids(Filter("ID", "=", 3)) == [3]
    assert ids(Filter("flag", "=", True)) == [1, 4, 6]
    with pytest.raises(SpecError):
        ids(Filter("n", "=", "ten"))
    with pytest.raises(SpecError):
        ids(Filter("nope", "=", 1))
    with pytest.raises(SpecError):
        ids(Filter("n", "like", "1%"))


def test_like_has_no_escape_character(frame):
    assert [r.id for r in where(frame, [Filter("name", "like", "b\\_")]).collect()] == [5]


def test_sorting_puts_nulls_last_both_ways(frame):
    order = lambda d: [r.id for r in apply_query(frame, QuerySpec("t", sort=(Sort("x", d), Sort("id")))).collect()]
    assert order("asc") == [3, 6, 1, 4, 5, 2]
    assert order("desc") == [4, 5, 1, 6, 3, 2]


def test_pages(frame):
    page = lambda p: [r.id for r in apply_query(frame, QuerySpec("t", sort=(Sort("id"),), limit=4, page=p)).collect()]
    assert page(1) == [1, 2, 3, 4] and page(2) == [5, 6] and page(3) == []
    assert count_total(frame, [Filter("x", ">", 0)]).first().n == 3


def test_unselected_sort_and_group_quirks(frame):
    rows = apply_query(frame, QuerySpec("t", ("name",), sort=(Sort("id", "desc"),), limit=1))
    assert rows.columns == ["name"] and rows.first().name == "a%"
    assert apply_query(frame, QuerySpec("t", ("flag",), group_by=("flag",))).count() == len(ROWS)
    spec = QuerySpec("t", ("id",), (Aggregation("count", None, "c"),), ("flag",))
    assert apply_query(frame, spec).columns == ["flag", "c"]


@pytest.mark.parametrize("fn,col", [("sum", "name"), ("avg", "name"), ("stddev", "ts"), ("median", "name"), ("sum", "ts"), ("avg", "flag")])
def test_aggregates_reject_wrong_types(frame, fn, col):
    with pytest.raises(SpecError):
        apply_query(frame, QuerySpec("t", aggregations=(Aggregation(fn, col, "o"),)))


def test_sums_of_large_integers_do_not_overflow(spark):
    big = spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "v bigint")
    row = apply_query(big, QuerySpec("t", aggregations=(Aggregation("sum", "v", "s"),))).first()
    assert int(row.s) == 3 * 2**62
    values = [-(2**63), 2**63 - 1, -1, 0, 5, -(2**44), 2**44 + 2**22 + 1, -(2**63), -(2**22) - 7, None]
    for part in (values, values[:1] * 5, values[-1:], values[:3]):
        frame = spark.createDataFrame([(v,) for v in part], "v bigint")
        row = apply_query(frame, QuerySpec("t", aggregations=(Aggregation("sum", "v", "s"),))).first()
        present = [v for v in part if v is not None]
        assert row.s == (sum(present) if present else None)


def test_empty_global_aggregate_is_one_row(frame):
    aggs = tuple(Aggregation(f, "x", f) for f in ("sum", "avg", "min", "median", "stddev", "count"))
    assert [tuple(r) for r in grouped(frame.filter("id > 99"), (), aggs).collect()] == [(None, None, None, None, None, 0)]


def test_explain_shape_surfaces_errors(frame):
    assert explain_shape(QuerySpec("t", ("id",)), frame).names == ["id"]
    with pytest.raises(SpecError):
        explain_shape(QuerySpec("t", sort=(Sort("nope"),)), frame)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(
    st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-50, 50).map(lambda i: i / 4))),
        min_size=1,
        max_size=60,
    ),
    st.sampled_from([20, 100, 20_000]),
)
def test_medians_in_wide_and_narrow_ranges_equal_the_direct_ones(spark, rows, accuracy):
    """With coarse sketches too; a wide decimal, a narrow one and a double of one query."""
    df = spark.createDataFrame(rows, "k string, v double").select("k", "v", F.col("v").cast("decimal(30,4)").alias("w"), F.col("v").cast("decimal(9,4)").alias("d"))
    for c in "vwd":
        some = plain(df.groupBy("k").agg(F.median(c).alias("m")).where("m is not null").collect())
        assert plain(exact_median(df, ["k"], c, "m", accuracy).collect()) == some
        assert plain(exact_median(df, [], c, "m", accuracy).select("m").collect()) == plain(df.agg(F.median(c).alias("m")).where("m is not null").collect())


MEDIAN = (Aggregation("median", "v", "m"),)
INFINITE, NAN = float("inf"), float("nan")
EDGES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7e308, -1.7e308, 1.7976931348623157e308, INFINITE, -INFINITE,
         NAN, 0.1, 3.0, 2.0**52 - 1, 2.0**53, 1 / 3, 1e-310, 8.0 - 2**-50, 8.0, 1024.0, 1e22]


def test_keys_keep_the_order_of_doubles_and_give_them_back(spark):
    import random
    import struct

    dice = random.Random(1)
    values = EDGES + [struct.unpack("<d", dice.randbytes(8))[0] for _ in range(4000)] + [2.0**e * f for e in range(-1074, 1024, 7) for f in (1, 1 - 2**-53)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    kind = df.schema["v"].dataType
    got = with_keys(df, F.col("v"), kind, "k").withColumn("b", key_value(F.col("k"), kind)).collect()
    assert all(r["b"] == r["v"] or r["b"] != r["b"] and r["v"] != r["v"] for r in got)
    real = sorted((r["v"], r["k"]) for r in got if r["v"] == r["v"])
    assert all((a < b) == (k < m) for (a, k), (b, m) in zip(real, real[1:], strict=False))
    assert min(r["k"] for r in got if r["v"] != r["v"]) > real[-1][1]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.sampled_from(EDGES), st.floats(width=64))), min_size=1, max_size=40))
def test_median_equals_the_direct_one(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    text = lambda frame: sorted(str(tuple(r)).replace("-0.0", "0.0") for r in frame.collect())
    assert text(grouped(df, ["k"], MEDIAN)) == text(df.groupBy("k").agg(F.median("v").alias("m")))
    assert text(grouped(df, [], MEDIAN)) == text(df.agg(F.median("v").alias("m")))


@pytest.mark.parametrize("values,want", [([NAN, 1.0, NAN, 2.0, INFINITE], INFINITE), ([1.7e308, 1.7e308], 1.7e308), ([1.7e308, 1.75e308], 1.725e308), ([None, None], None), ([], None)])
def test_median_of_probed_values(spark, values, want):
    """The same from a few rows and from many copies of them."""
    for copies in (1, 2000):
        df = spark.createDataFrame([(v,) for v in values], "v double").crossJoin(spark.range(copies))
        assert grouped(df, [], MEDIAN).first()["m"] == want


def test_median_with_a_hot_group_is_counted_before_the_shuffle(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(-1).alias("k"), ((F.col("id") * 7919) % 10_007).alias("v"), (F.col("id") * 1e-3).alias("w")
    )
    want = rows_of(df.groupBy("k").agg(F.median("v").alias("m"), F.median("w").alias("x"), F.count(F.lit(1)).alias("n")))
    aggregations = (*MEDIAN, Aggregation("median", "w", "x"), Aggregation("count", None, "n"))
    result = grouped(df, ["k"], aggregations)
    assert rows_of(result) == want
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "partial_percentile_approx" in plan and "partial_count" in plan and "CartesianProduct" not in plan


def test_medians_of_decimals_and_times_round_like_the_oracle(frame, duck):
    spec = QuerySpec("t", aggregations=(Aggregation("median", "d", "d"), Aggregation("median", "ts", "t")), group_by=("flag",))
    want = duck.execute(query_text(spec)[0], query_text(spec)[1]).fetchall()
    assert plain(tuple(r) for r in apply_query(frame, spec).collect()) == plain(want)
    wide = frame.withColumn("d", F.col("d").cast("decimal(30,2)"))
    assert plain(tuple(r) for r in apply_query(wide, spec).collect()) == plain(want)


def test_value_at_rank(spark):
    df = spark.range(5000).select(((F.col("id") * 37) % 5000).alias("v")).unionByName(spark.createDataFrame([(None,)] * 9, "v bigint"))
    for kind in ("bigint", "double", "decimal(12,3)", "string", "decimal(30,2)"):
        sized = df.select(F.lpad(F.col("v"), 4, "0").alias("v") if kind == "string" else F.col("v").cast(kind))
        for rank in (1, 2, 2500, 5000):
            assert float(value_at_rank(sized, "v", rank)) == rank - 1
        assert value_at_rank(sized, "v", 5001) is None and value_at_rank(sized, "v", 0) is None
    same = spark.range(3000).select(F.lit(4).alias("v"))
    assert value_at_rank(same, "v", 1500) == 4
    times = df.select(F.timestamp_micros(F.col("v") * 1_000_003).alias("v"))
    assert value_at_rank(times, "v", 5000) == times.agg(F.max("v")).first()[0]


def test_filters_and_columns_reach_the_scan(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    spec = QuerySpec(
        "t",
        aggregations=(Aggregation("sum", "l_quantity", "q"),),
        group_by=("l_linestatus",),
        filters=(Filter("l_shipdate", ">=", "1998-01-01"), Filter("l_returnflag", "in", ["A", "R"])),
    )
    plan = apply_query(lines, spec)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "In(l_returnflag" in plan
    assert "l_extendedprice" not in plan and "l_orderkey" not in plan
