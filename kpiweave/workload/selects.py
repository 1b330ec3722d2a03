"""User SELECTs over the tables, checked by the guard and run by Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kpiweave.plans.loads import select_over
from kpiweave.workload import registered

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _select(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    readers = {name: (lambda session, n=name: session.read.parquet(f"{folder}/{n}.parquet")) for name in TABLES}
    return select_over(spark, readers, sql)[0]


# The same text runs in both engines: double-quoted names, standard functions.
JOINS = """SELECT n."n_name" AS nation, count(*) AS orders, count(DISTINCT o.o_custkey) AS customers
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n."n_name" """
HAVING = """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) AS n FROM lineitem
GROUP BY l_suppkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') > count(*) / 3.0"""
GROUPING = """SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_extendedprice) AS top FROM lineitem
GROUP BY CUBE (l_returnflag, l_linestatus)"""
SETS = """SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier
UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1"""
DIFFERENCE = """SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem"""
SUBQUERIES = """WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, top FROM customer JOIN big ON c_custkey = o_custkey
WHERE top > (SELECT avg(o_totalprice) FROM orders) AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey IN (0, 2))"""
WINDOWS = """SELECT o_custkey, o_orderkey, row_number() OVER w AS nth, o_totalprice - lag(o_totalprice) OVER w AS step
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
FUNCTIONS = """SELECT upper(substring(c_name, 1, 8)) AS stem, c_mktsegment, count(*) AS n, max(length(c_name)) AS longest,
CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS in_debt FROM customer GROUP BY 1, 2"""
AS_OF = """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END{}) OVER
(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events"""
SEMI = """SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)
AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)"""


@registered("X3 J4", JOINS)
def select_joins(spark: SparkSession, folder: str) -> DataFrame:
    return _select(spark, folder, JOINS)


@registered("X5 HAVING, FILTER", HAVING)
def select_having(spark: SparkSession, folder: str) -> DataFrame:
    return _select(spark, folder, HAVING)


@registered("X5 grouping sets", GROUPING)
def select_cube(spark: SparkSession, folder: str) -> DataFrame:
    return _select(spark, folder, GROUPING)


@registered("X8 U3", SETS)
def select_set_operations(spark: SparkSession, folder: str) -> DataFrame:
    return _select(spark, folder, SETS)


@registered("X8 U3", DIFFERENCE)
def select_difference(spark: SparkSession, folder: str) -> DataFrame:
    return _select(spark, folder, DIFFERENCE)


@registered("X7", SUBQUERIES)
def select_subqueries(spark: SparkSession, folder: str) -> DataFrame:
    return _select(spark, folder, SUBQUERIES)


@registered("X6", "SELECT o_custkey, o_orderkey, CAST(nth AS INTEGER) AS nth, round(step, 2) AS step FROM (" + WINDOWS + ")")
def select_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _select(spark, folder, "SELECT o_custkey, o_orderkey, nth, round(step, 2) AS step FROM (" + WINDOWS + ")")


@registered("X9", FUNCTIONS)
def select_functions(spark: SparkSession, folder: str) -> DataFrame:
    return _select(spark, folder, FUNCTIONS)


@registered("X3 semi and anti joins", SEMI)
def select_semi_joins(spark: SparkSession, folder: str) -> DataFrame:
    return _select(spark, folder, SEMI)


@registered("X4 as-of: the latest purchase at each event", AS_OF.format(" IGNORE NULLS"))
def select_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return _select(spark, folder, AS_OF.format(", true"))
