"""Structured queries: projection, filters, aggregates, sorting, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiweave.operators.incremental import capped, high_mark, since
from kpiweave.operators.query import apply_query, count_total, grouped, unpaged
from kpiweave.specs import Aggregation, Filter, QuerySpec
from kpiweave.workload import registered
from kpiweave.workload.frames import KPI_SQL, as_bigint, kpi_feed, rounded, table, whole

FLAGSHIP = {
    "table": "hybrid_cs_cell",
    "aggregations": [{"fn": "avg", "col": "traffic", "as": "traffic"}, {"fn": "count", "as": "samples"}],
    "groupBy": ["hour_ts", "region"],
}


@registered(
    "A2 A7 A9 O1 O2 D9 line chart",
    f"""SELECT hour_ts, region, round(avg(traffic), 9) AS traffic, count(*) AS samples
    FROM {KPI_SQL} GROUP BY hour_ts, region ORDER BY hour_ts, region""",
)
def kpi_by_hour_and_region(spark: SparkSession, folder: str) -> DataFrame:
    every = unpaged(kpi_feed(spark, folder), QuerySpec.from_json(FLAGSHIP))
    return rounded(every, 9, "traffic").orderBy("hour_ts", "region")


# --- projection -----------------------------------------------------------------------


@registered("F1", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def project_columns(spark: SparkSession, folder: str) -> DataFrame:
    return whole(table(spark, folder, "orders"), columns=["o_orderkey", "o_totalprice", "o_orderdate"])


@registered("F2", "SELECT * FROM customer")
def project_star(spark: SparkSession, folder: str) -> DataFrame:
    return whole(table(spark, folder, "customer"))


@registered(
    "F3",
    "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus",
)
def aggregation_ignores_columns(spark: SparkSession, folder: str) -> DataFrame:
    return whole(
        table(spark, folder, "orders"),
        columns=["o_orderkey", "o_custkey"],
        groupBy=["o_orderstatus"],
        aggregations=[{"fn": "count", "as": "n"}, {"fn": "max", "col": "o_totalprice", "as": "top"}],
    )


@registered("F4", "SELECT o_orderstatus FROM orders")
def group_without_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    return whole(table(spark, folder, "orders"), columns=["o_orderstatus"], groupBy=["o_orderstatus"])


# --- filters ---------------------------------------------------------------------------

_LINE_AGGS = [
    {"fn": "count", "as": "n"},
    {"fn": "sum", "col": "l_quantity", "as": "quantity"},
    {"fn": "max", "col": "l_shipdate", "as": "last_ship"},
]
_LINE_SQL = """SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
    max(l_shipdate) AS last_ship FROM lineitem WHERE {} GROUP BY l_linestatus"""


def _lines(spark: SparkSession, folder: str, *filters: tuple) -> DataFrame:
    return rounded(
        whole(
            table(spark, folder, "lineitem"),
            groupBy=["l_linestatus"],
            aggregations=_LINE_AGGS,
            filters=[{"col": c, "op": op, "value": v} for c, op, v in filters],
        ),
        2,
        "quantity",
    )


@registered("F5 F14", _LINE_SQL.format("l_returnflag = 'R'"))
def filter_equal(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, ("l_returnflag", "=", "R"))


@registered("F5 text bound to a number column", _LINE_SQL.format("l_linenumber = 3"))
def filter_equal_text_number(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, ("l_linenumber", "=", "3"))


@registered("F6", _LINE_SQL.format("l_returnflag <> 'R'"))
def filter_not_equal(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, ("l_returnflag", "!=", "R"))


@registered(
    "F6 NULL rows drop",
    f"SELECT region, count(*) AS n FROM {KPI_SQL} WHERE failing_cell <> 1 GROUP BY region",
)
def filter_not_equal_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return whole(
        kpi_feed(spark, folder),
        groupBy=["region"],
        aggregations=[{"fn": "count", "as": "n"}],
        filters=[{"col": "failing_cell", "op": "!=", "value": 1}],
    )


@registered("F7", _LINE_SQL.format("l_quantity >= 10 AND l_quantity < 40 AND l_discount > 0.02 AND l_tax <= 0.05"))
def filter_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(
        spark,
        folder,
        ("l_quantity", ">=", 10),
        ("l_quantity", "<", 40),
        ("l_discount", ">", 0.02),
        ("l_tax", "<=", 0.05),
    )


@registered("F7 fraction against integers", _LINE_SQL.format("l_linenumber > 2.5"))
def filter_fraction_on_integer(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, ("l_linenumber", ">", 2.5))


@registered("F7 ISO text on a timestamp", _LINE_SQL.format("l_shipdate > TIMESTAMP '1998-06-01 00:00:00'"))
def filter_time_text(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, ("l_shipdate", ">", "1998-06-01T00:00:00Z"))


@registered("F8", _LINE_SQL.format("l_returnflag IN ('A', 'N')"))
def filter_in(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, ("l_returnflag", "in", ["A", "N"]))


@registered("F8 empty list", _LINE_SQL.format("1 = 0"))
def filter_in_empty(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, ("l_returnflag", "in", []))


@registered("F9", _LINE_SQL.format("l_linenumber NOT IN (1, 2, 7)"))
def filter_not_in(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, ("l_linenumber", "not_in", [1, 2, 7]))


@registered("F9 empty list", _LINE_SQL.format("1 = 1"))
def filter_not_in_empty(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, ("l_returnflag", "not_in", []))


@registered("F9 NULL in the list", _LINE_SQL.format("l_returnflag NOT IN ('A', NULL)"))
def filter_not_in_null(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, ("l_returnflag", "not_in", ["A", None]))


@registered(
    "F10",
    """SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part
    WHERE p_name LIKE '%red%' AND p_brand LIKE 'Brand#_' GROUP BY p_type""",
)
def filter_like(spark: SparkSession, folder: str) -> DataFrame:
    return whole(
        table(spark, folder, "part"),
        groupBy=["p_type"],
        aggregations=[{"fn": "count", "as": "n"}, {"fn": "count_distinct", "col": "p_brand", "as": "brands"}],
        filters=[
            {"col": "p_name", "op": "like", "value": "%red%"},
            {"col": "p_brand", "op": "like", "value": "Brand#_"},
        ],
    )


@registered(
    "F11",
    """SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'
      AND o_totalprice BETWEEN 1000 AND 200000 GROUP BY o_orderpriority""",
)
def filter_between(spark: SparkSession, folder: str) -> DataFrame:
    return whole(
        table(spark, folder, "orders"),
        groupBy=["o_orderpriority"],
        aggregations=[{"fn": "count", "as": "n"}],
        filters=[
            {"col": "o_orderdate", "op": "between", "value": ["1996-01-01", "1997-12-31"]},
            {"col": "o_totalprice", "op": "between", "value": [1000, 200000]},
        ],
    )


@registered("F12", f"SELECT region, count(*) AS n FROM {KPI_SQL} WHERE drops IS NULL GROUP BY region")
def filter_is_null(spark: SparkSession, folder: str) -> DataFrame:
    return whole(
        kpi_feed(spark, folder),
        groupBy=["region"],
        aggregations=[{"fn": "count", "as": "n"}],
        filters=[{"col": "drops", "op": "is_null"}],
    )


@registered("F12", f"SELECT cell_id, count(*) AS n FROM {KPI_SQL} WHERE drops IS NOT NULL GROUP BY cell_id")
def filter_is_not_null(spark: SparkSession, folder: str) -> DataFrame:
    return whole(
        kpi_feed(spark, folder),
        groupBy=["cell_id"],
        aggregations=[{"fn": "count", "as": "n"}],
        filters=[{"col": "drops", "op": "is_not_null"}],
    )


@registered(
    "F13",
    _LINE_SQL.format("l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 5 AND 45 AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_linenumber <> 4"),
)
def filter_conjunction(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(
        spark,
        folder,
        ("l_returnflag", "in", ["A", "R"]),
        ("l_quantity", "between", [5, 45]),
        ("l_shipdate", ">=", "1996-01-01"),
        ("l_linenumber", "!=", 4),
    )


@registered("F14 hostile text stays a value", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'x'' OR ''1''=''1'")
def filter_hostile_text(spark: SparkSession, folder: str) -> DataFrame:
    return whole(
        table(spark, folder, "customer"),
        aggregations=[{"fn": "count", "as": "n"}],
        filters=[{"col": "c_mktsegment", "op": "=", "value": "x' OR '1'='1"}],
    )


@registered("A11", "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_returnflag <> 'N'")
def count_filtered_rows(spark: SparkSession, folder: str) -> DataFrame:
    filters = [Filter("l_shipdate", ">=", "1997-01-01"), Filter("l_returnflag", "!=", "N")]
    return count_total(table(spark, folder, "lineitem"), filters)


# --- aggregates ------------------------------------------------------------------------


def _by_flags(spark: SparkSession, folder: str, *aggs: dict) -> DataFrame:
    return whole(
        table(spark, folder, "lineitem"), groupBy=["l_returnflag", "l_linestatus"], aggregations=list(aggs)
    )


@registered(
    "A1 A9",
    """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS price,
      CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(l_partkey) AS BIGINT) AS part_sum
    FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def aggregate_sum(spark: SparkSession, folder: str) -> DataFrame:
    sums = _by_flags(
        spark,
        folder,
        {"fn": "sum", "col": "l_extendedprice", "as": "price"},
        {"fn": "sum", "col": "l_linenumber", "as": "lines"},
        {"fn": "sum", "col": "l_partkey", "as": "part_sum"},
    )
    return as_bigint(rounded(sums, 2, "price"), "part_sum")


@registered(
    "A2",
    """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount,
      round(avg(l_linenumber), 6) AS line FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def aggregate_avg(spark: SparkSession, folder: str) -> DataFrame:
    means = _by_flags(
        spark,
        folder,
        {"fn": "avg", "col": "l_quantity", "as": "quantity"},
        {"fn": "avg", "col": "l_discount", "as": "discount"},
        {"fn": "avg", "col": "l_linenumber", "as": "line"},
    )
    return rounded(means, 6, "quantity", "discount", "line")


@registered(
    "A3 A4",
    """SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderdate) AS first_day,
      max(o_orderdate) AS last_day, min(o_orderstatus) AS first_status, max(o_orderstatus) AS last_status
    FROM orders GROUP BY o_orderpriority""",
)
def aggregate_min_max(spark: SparkSession, folder: str) -> DataFrame:
    pairs = [("min", "o_totalprice", "low"), ("max", "o_totalprice", "high")]
    pairs += [("min", "o_orderdate", "first_day"), ("max", "o_orderdate", "last_day")]
    pairs += [("min", "o_orderstatus", "first_status"), ("max", "o_orderstatus", "last_status")]
    return whole(
        table(spark, folder, "orders"),
        groupBy=["o_orderpriority"],
        aggregations=[{"fn": f, "col": c, "as": a} for f, c, a in pairs],
    )


_MEDIAN_SQL = """SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS price,
    round(median(l_quantity), 4) AS quantity, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"""
_MEDIANS = (
    Aggregation("median", "l_extendedprice", "price"),
    Aggregation("median", "l_quantity", "quantity"),
    Aggregation("count", None, "n"),
)


@registered("A5", _MEDIAN_SQL)
def aggregate_median(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return rounded(grouped(lines, ["l_returnflag", "l_linestatus"], _MEDIANS), 4, "price", "quantity")


@registered("A5 all medians of a query in one selection", _MEDIAN_SQL)
def aggregate_median_wide(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    medians = grouped(lines, ["l_returnflag", "l_linestatus"], _MEDIANS)
    return rounded(medians, 4, "price", "quantity")


@registered(
    "A5 A2 of times",
    "SELECT event_type, median(ts) AS middle, avg(ts) AS mean FROM events GROUP BY event_type",
)
def aggregate_time_middle(spark: SparkSession, folder: str) -> DataFrame:
    return whole(
        table(spark, folder, "events"),
        groupBy=["event_type"],
        aggregations=[{"fn": "median", "col": "ts", "as": "middle"}, {"fn": "avg", "col": "ts", "as": "mean"}],
    )


@registered(
    "A6",
    """SELECT l_returnflag, l_linestatus, round(stddev(l_extendedprice), 4) AS price, round(stddev(l_quantity), 6) AS quantity
    FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def aggregate_stddev(spark: SparkSession, folder: str) -> DataFrame:
    spreads = _by_flags(
        spark,
        folder,
        {"fn": "stddev", "col": "l_extendedprice", "as": "price"},
        {"fn": "stddev", "col": "l_quantity", "as": "quantity"},
    )
    return rounded(rounded(spreads, 4, "price"), 6, "quantity")


@registered("A6 one row gives NULL", "SELECT s_suppkey, stddev(s_acctbal) AS spread FROM supplier GROUP BY s_suppkey")
def aggregate_stddev_single(spark: SparkSession, folder: str) -> DataFrame:
    return whole(
        table(spark, folder, "supplier"),
        groupBy=["s_suppkey"],
        aggregations=[{"fn": "stddev", "col": "s_acctbal", "as": "spread"}],
    )


@registered(
    "A7 A8",
    f"""SELECT region, count(*) AS n, count(drops) AS with_drops, count(DISTINCT cell_id) AS cells,
      count(DISTINCT failing_cell) AS failing FROM {KPI_SQL} GROUP BY region""",
)
def aggregate_counts(spark: SparkSession, folder: str) -> DataFrame:
    return whole(
        kpi_feed(spark, folder),
        groupBy=["region"],
        aggregations=[
            {"fn": "count", "as": "n"},
            {"fn": "count", "col": "drops", "as": "with_drops"},
            {"fn": "count_distinct", "col": "cell_id", "as": "cells"},
            {"fn": "count_distinct", "col": "failing_cell", "as": "failing"},
        ],
    )


@registered(
    "A9 NULL is a group",
    f"SELECT failing_cell, count(*) AS n, round(sum(traffic), 2) AS traffic, round(median(traffic), 4) AS middle FROM {KPI_SQL} GROUP BY failing_cell",
)
def group_with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    groups = whole(
        kpi_feed(spark, folder),
        groupBy=["failing_cell"],
        aggregations=[
            {"fn": "count", "as": "n"},
            {"fn": "sum", "col": "traffic", "as": "traffic"},
            {"fn": "median", "col": "traffic", "as": "middle"},
        ],
    )
    return rounded(rounded(groups, 2, "traffic"), 4, "middle")


_ALL_AGGS = [
    ("sum", "o_totalprice", "total"),
    ("avg", "o_totalprice", "mean"),
    ("min", "o_totalprice", "low"),
    ("max", "o_totalprice", "high"),
    ("median", "o_totalprice", "middle"),
    ("stddev", "o_totalprice", "spread"),
    ("count", "o_totalprice", "n"),
    ("count_distinct", "o_custkey", "customers"),
]
_ALL_SQL = """SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low,
    max(o_totalprice) AS high, round(median(o_totalprice), 4) AS middle, round(stddev(o_totalprice), 4) AS spread,
    count(o_totalprice) AS n, count(DISTINCT o_custkey) AS customers FROM orders"""


def _global(spark: SparkSession, folder: str, filters: list) -> DataFrame:
    row = whole(
        table(spark, folder, "orders"),
        aggregations=[{"fn": f, "col": c, "as": a} for f, c, a in _ALL_AGGS],
        filters=filters,
    )
    return rounded(rounded(row, 2, "total"), 4, "mean", "middle", "spread")


@registered("A10", _ALL_SQL)
def aggregate_global(spark: SparkSession, folder: str) -> DataFrame:
    return _global(spark, folder, [])


@registered("A10 empty input gives one row", _ALL_SQL + " WHERE o_totalprice < 0")
def aggregate_global_empty(spark: SparkSession, folder: str) -> DataFrame:
    return _global(spark, folder, [{"col": "o_totalprice", "op": "<", "value": 0}])


@registered("A13", "SELECT count(*) AS rows_read, max(event_id) AS last_id, max(ts) AS last_ts FROM events")
def high_marks(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    marks = events.agg(
        F.count(F.lit(1)).alias("rows_read"),
        high_mark(events.schema, "event_id").alias("last_id"),
        high_mark(events.schema, "ts").alias("last_ts"),
    )
    return marks.select("rows_read", F.col("last_id").cast("bigint"), F.col("last_ts").cast("timestamp_ntz"))


# --- sorting and paging ------------------------------------------------------------------


def _sorted(spark: SparkSession, folder: str, direction: str) -> DataFrame:
    spec = QuerySpec.from_json(
        {
            "table": "kpi",
            "columns": ["event_id", "region", "drops"],
            "sort": [{"col": "drops", "dir": direction}],
            "limit": 100,
        }
    )
    return apply_query(kpi_feed(spark, folder), spec, tie_break=("event_id",))


@registered(
    "O1 NULLs last ascending",
    f"SELECT event_id, region, drops FROM {KPI_SQL} ORDER BY drops ASC NULLS LAST, event_id LIMIT 100",
)
def sort_ascending(spark: SparkSession, folder: str) -> DataFrame:
    return _sorted(spark, folder, "asc")


@registered(
    "O1 NULLs last descending",
    f"SELECT event_id, region, drops FROM {KPI_SQL} ORDER BY drops DESC NULLS LAST, event_id LIMIT 100",
)
def sort_descending(spark: SparkSession, folder: str) -> DataFrame:
    return _sorted(spark, folder, "desc")


@registered(
    "O1 sort by a column not returned",
    "SELECT c_name, c_mktsegment FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50",
)
def sort_by_unselected(spark: SparkSession, folder: str) -> DataFrame:
    spec = QuerySpec.from_json(
        {
            "table": "customer",
            "columns": ["c_name", "c_mktsegment"],
            "sort": [{"col": "c_acctbal", "dir": "desc"}],
            "limit": 50,
        }
    )
    return apply_query(table(spark, folder, "customer"), spec, tie_break=("c_custkey",))


@registered("O2 O3", "SELECT * FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 500 OFFSET 1000")
def page_three(spark: SparkSession, folder: str) -> DataFrame:
    spec = QuerySpec.from_json(
        {"table": "lineitem", "sort": [{"col": "l_shipdate", "dir": "desc"}], "limit": 500, "page": 3}
    )
    ties = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return apply_query(table(spark, folder, "lineitem"), spec, tie_break=ties)


@registered(
    "O4",
    """SELECT o_custkey, round(sum(o_totalprice), 2) AS traffic, count(*) AS drops FROM orders GROUP BY o_custkey
    ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 25""",
)
def top_customers(spark: SparkSession, folder: str) -> DataFrame:
    spec = QuerySpec.from_json(
        {
            "table": "orders",
            "groupBy": ["o_custkey"],
            "aggregations": [{"fn": "sum", "col": "o_totalprice", "as": "traffic"}, {"fn": "count", "as": "drops"}],
            "sort": [{"col": "traffic", "dir": "desc"}],
            "limit": 25,
        }
    )
    return rounded(apply_query(table(spark, folder, "orders"), spec, tie_break=("o_custkey",)), 2, "traffic")


@registered("O5 S19 oldest rows up to the cap", "SELECT * FROM events ORDER BY ts LIMIT 2500")
def extract_oldest(spark: SparkSession, folder: str) -> DataFrame:
    return capped(table(spark, folder, "events"), "ts", 2500)


@registered(
    "O5 a cap never cuts through equal marks",
    """SELECT * FROM orders WHERE o_orderdate < (SELECT o_orderdate FROM orders ORDER BY o_orderdate LIMIT 1 OFFSET 1000)""",
)
def extract_oldest_with_ties(spark: SparkSession, folder: str) -> DataFrame:
    return capped(table(spark, folder, "orders"), "o_orderdate", 1000)


MARKED_SQL = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS mark FROM events"


@registered(
    "O5 S19 rows without a mark come with the first extract",
    f"""SELECT * FROM ({MARKED_SQL}) WHERE mark IS NULL OR mark <
        (SELECT mark FROM ({MARKED_SQL}) WHERE mark IS NOT NULL ORDER BY mark LIMIT 1 OFFSET 2500)
        OR (SELECT count(mark) FROM ({MARKED_SQL})) <= 2500""",
)
def extract_capped_null_marks(spark: SparkSession, folder: str) -> DataFrame:
    mark = F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("mark")
    return capped(table(spark, folder, "events").select("event_id", mark), "mark", 2500)


@registered("F17", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'")
def extract_after_mark(spark: SparkSession, folder: str) -> DataFrame:
    return since(table(spark, folder, "events"), "ts", "2024-01-20T12:00:00")


@registered("F17 integer marks compare as numbers", "SELECT * FROM orders WHERE o_orderkey > 999")
def extract_after_integer_mark(spark: SparkSession, folder: str) -> DataFrame:
    return since(table(spark, folder, "orders"), "o_orderkey", "999")


# --- filters on decimal columns -------------------------------------------------------

DECIMAL_SQL = "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS price FROM lineitem"


def _prices(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)").alias("price")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", price)


def _decimal_filter(name: str, op: str, value: object, condition: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return whole(_prices(spark, folder), filters=[{"col": "price", "op": op, "value": value}])

    run.__name__ = f"filter_decimal_{name}"
    registered("F5-F9 F11 numbers keep their own scale", f"SELECT * FROM ({DECIMAL_SQL}) WHERE price {condition}")(run)


for _name, _op, _value, _condition in (
    ("equal", "=", 20000.005, "= 20000.005"),
    ("not_equal", "!=", "20000.005", "<> 20000.005"),
    ("above", ">", 19999.995, "> 19999.995"),
    ("above_text", ">", "19999.995", "> 19999.995"),
    ("at_least", ">=", 20000.001, ">= 20000.001"),
    ("below", "<", "20000.001", "< 20000.001"),
    ("at_most", "<=", 20000.009, "<= 20000.009"),
    ("in", "in", [20000.0, "30000.10", 1.005], "IN (20000.0, 30000.10, 1.005)"),
    ("not_in", "not_in", [20000.0, 30000.125], "NOT IN (20000.0, 30000.125)"),
    ("between", "between", [20000.001, "21000.999"], "BETWEEN 20000.001 AND 21000.999"),
):
    _decimal_filter(_name, _op, _value, _condition)
