"""Catalog, freshness, run reports, rollups and dashboards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiweave.functions.timing import interval_column
from kpiweave.operators.query import apply_query, unpaged
from kpiweave.plans.catalog import (
    catalog,
    job_metrics,
    latest_versions,
    newest_runs,
    overdue,
    refresh_rollup,
    stalled_marks,
    with_staleness,
)
from kpiweave.plans.dashboard import cascaded, map_cells, pivot_series, run_dashboard, shape, shares, site_totals, with_sites
from kpiweave.plans.loads import load_frame
from kpiweave.specs import DEFAULT_LIMIT, Dashboard, Filter, JobSource, JobSpec, QuerySpec, Schedule, Widget
from kpiweave.workload import registered
from kpiweave.workload.frames import KPI_SQL, kpi_feed, new_store, rounded, table, whole

REGION_NAMES = ("click", "error", "purchase", "signup", "view")  # the feed's series, fixed


# --- catalog and freshness ---------------------------------------------------------------


@registered(
    "C1 C9 J2 catalog of loaded tables",
    """SELECT 'customer' AS table_name, count(*) AS row_count, 1 AS table_version, 86400 AS interval_s, true AS stale FROM customer
    UNION ALL SELECT 'nation', count(*), 1, 3600, true FROM nation
    UNION ALL SELECT 'supplier', count(*), 2, 864000000, false FROM supplier""",
)
def catalog_listing(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "catalog")
    for name in ("customer", "nation", "supplier", "supplier"):
        load_frame(store, name, table(spark, folder, name), "full")
    every = {"customer": "1d", "supplier": "10000d"}
    jobs = [
        JobSpec(f"load_{name}", JobSource(kind="csv", upload_id="u"), name, Schedule(every=text), load_mode="full")
        for name, text in every.items()
    ]
    # Seen ten years later: only a table on a very slow schedule is still fresh.
    later = datetime.now().replace(year=datetime.now().year + 10, day=1)
    listing = catalog(store, jobs, later).select("table_name", "row_count", "table_version", "interval_s", "stale")
    return listing.withColumn("table_version", F.col("table_version").cast("int")).withColumn(
        "interval_s", F.col("interval_s").cast("int")
    )


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells as tables: the newest row of each is its last load."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("table_name"), F.col("event_id").alias("version"), "ts", "event_type"
    )
    return latest_versions(rows, "table_name", "version")


@registered(
    "C1 newest version per table",
    """SELECT user_id AS table_name, max(event_id) AS version, arg_max(ts, event_id) AS ts, arg_max(event_type, event_id) AS event_type
    FROM events GROUP BY user_id""",
)
def newest_versions(spark: SparkSession, folder: str) -> DataFrame:
    return _cells(spark, folder)


@registered(
    "C3 C4 J2",
    """WITH last AS (SELECT user_id AS table_name, max(event_id) AS version, arg_max(ts, event_id) AS ts FROM events GROUP BY user_id),
      plan AS (SELECT DISTINCT user_id, (user_id % 5 + 1) * 43200 AS interval_s FROM events WHERE user_id % 3 <> 0)
    SELECT table_name, version, CAST(coalesce(interval_s, 3600) AS BIGINT) AS interval_s,
      ts IS NULL OR epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) > CAST(coalesce(interval_s, 3600) AS BIGINT) * 2000000 AS stale
    FROM last LEFT JOIN plan ON table_name = user_id""",
)
def staleness(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "events").select("user_id").distinct()
    # Two of three cells have a schedule; the others count as hourly.
    schedules = users.filter(F.col("user_id") % 3 != 0).select(
        F.col("user_id").alias("job_table"),
        F.concat(((F.col("user_id") % 5 + 1) * 12).cast("string"), F.lit("h")).alias("every"),
    )
    newest = table(spark, folder, "events").agg(F.max("ts")).first()[0]
    as_of = F.lit(newest.isoformat(sep=" ")).cast("timestamp_ntz")
    flagged = with_staleness(_cells(spark, folder), schedules, "ts", as_of)
    return flagged.select("table_name", "version", F.col("interval_s").cast("bigint"), "stale")


@registered(
    "C4 intervals of schedule texts",
    """SELECT event_type, CASE event_type WHEN 'view' THEN 45 WHEN 'click' THEN 900 WHEN 'error' THEN 7200 WHEN 'signup' THEN 86400 ELSE 3600 END AS seconds,
      count(*) AS n FROM events GROUP BY event_type""",
)
def schedule_intervals(spark: SparkSession, folder: str) -> DataFrame:
    texts = {"view": "45s", "click": " 15 m ", "error": "2h", "signup": "1d"}
    every = F.lit("0 * * * *")
    for kind, text in texts.items():
        every = F.when(F.col("event_type") == kind, F.lit(text)).otherwise(every)
    rows = table(spark, folder, "events").select("event_type", interval_column(every).cast("int").alias("seconds"))
    return rows.groupBy("event_type", "seconds").agg(F.count(F.lit(1)).alias("n"))


# --- runs ----------------------------------------------------------------------------------


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as load runs of one job per user; an error event is a failed run."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("job_name"),
        F.col("event_id").alias("run_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_dt_interval(secs=F.round("value").cast("int"))).alias("finished_at"),
        F.get_json_object("props", "$.k").cast("bigint").alias("rows_read"),
        F.get_json_object("props", "$.k").cast("bigint").alias("rows_written"),
        F.to_date("ts").alias("mark"),
    )


RUNS_SQL = """(SELECT user_id AS job_name, event_id AS run_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
    ts AS started_at, ts + to_seconds(CAST(round(value) AS INTEGER)) AS finished_at,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS rows_read, CAST(ts AS DATE) AS mark FROM events)"""


@registered(
    "C5 last 50 runs of each job",
    f"""SELECT job_name, run_id, status, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY run_id DESC) AS nth FROM {RUNS_SQL})
    WHERE nth <= 50""",
)
def run_history(spark: SparkSession, folder: str) -> DataFrame:
    return newest_runs(_runs(spark, folder), "job_name", "run_id").select("job_name", "run_id", "status", "nth")


@registered(
    "C6 metrics per job",
    f"""SELECT job_name, count(*) AS runs, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
      round(avg((epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0), 4) AS avg_seconds,
      max((epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0) AS max_seconds, CAST(sum(rows_read) AS BIGINT) AS rows_read,
      max(finished_at) FILTER (status = 'success') AS last_success FROM {RUNS_SQL} GROUP BY job_name""",
)
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    metrics = job_metrics(_runs(spark, folder), F.lit("2024-02-01").cast("timestamp_ntz"))
    chosen = metrics.select(
        "job_name", "runs", "succeeded", "failed", "avg_seconds", "max_seconds", "rows_read", "last_success"
    )
    return rounded(chosen, 4, "avg_seconds")


@registered(
    "C6 overdue loads",
    f"""SELECT job_name, last_success FROM (SELECT job_name, max(finished_at) FILTER (status = 'success') AS last_success FROM {RUNS_SQL} GROUP BY job_name)
    WHERE last_success IS NULL OR epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_success) > 43200000000""",
)
def overdue_jobs(spark: SparkSession, folder: str) -> DataFrame:
    runs = _runs(spark, folder)
    schedules = runs.select("job_name").distinct().withColumn("every", F.lit("6h"))
    metrics = job_metrics(runs, F.lit("2024-01-31").cast("timestamp_ntz"))
    return overdue(metrics, schedules).select("job_name", "last_success")


@registered(
    "C6 T4 stalled watermarks",
    f"""SELECT job_name, mark, runs AS runs_at_mark FROM (SELECT job_name, mark, count(*) AS runs, max(started_at) AS last_run,
      row_number() OVER (PARTITION BY job_name ORDER BY max(started_at) DESC) AS nth FROM {RUNS_SQL} GROUP BY job_name, mark)
    WHERE nth = 1 AND runs >= 3""",
)
def stalled_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return stalled_marks(_runs(spark, folder), "job_name", "mark", "started_at")


@registered(
    "C7 a rollup follows its input's version",
    """SELECT *, 2 AS rollup_version FROM (SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderpriority)""",
)
def rollup_refreshed(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "rollup")
    orders = table(spark, folder, "orders")
    spec = QuerySpec.from_json(
        {
            "table": "orders",
            "groupBy": ["o_orderpriority"],
            "aggregations": [{"fn": "count", "as": "n"}, {"fn": "max", "col": "o_totalprice", "as": "top"}],
        }
    )
    load_frame(store, "orders", orders.filter(F.col("o_orderstatus") == "F"), "full")
    refresh_rollup(store, "by_priority", spec)
    load_frame(store, "orders", orders, "full")
    for _ in range(2):
        # The second refresh finds the version unchanged.
        head, _ = refresh_rollup(store, "by_priority", spec)
    return store.read("by_priority").withColumn("rollup_version", F.lit(head.version))


# --- widgets ---------------------------------------------------------------------------------


def _widget(kind: str, query: dict, viz: dict | None = None) -> Widget:
    return Widget.from_json({"id": "w", "type": kind, "source": {"table": "kpi"}, "query": query, "viz": viz or {}})


def _shown(spark: SparkSession, folder: str, widget: Widget, names: tuple[str, ...] = ()) -> DataFrame:
    """The widget's rows in its shape; all rows unless the widget itself gives a limit."""
    feed, given = kpi_feed(spark, folder), widget.query.limit != DEFAULT_LIMIT
    return shape(widget, apply_query(feed, widget.query) if given else unpaged(feed, widget.query), names or None)


@registered("D5 D9", f"SELECT round(avg(traffic), 9) AS value FROM {KPI_SQL}")
def widget_average_traffic(spark: SparkSession, folder: str) -> DataFrame:
    widget = _widget("kpi", {"aggregations": [{"fn": "avg", "col": "traffic", "as": "value"}]})
    return rounded(_shown(spark, folder, widget), 9, "value")


@registered("D5 D9", f"SELECT round(avg(drops), 9) AS value FROM {KPI_SQL}")
def widget_average_drops(spark: SparkSession, folder: str) -> DataFrame:
    widget = _widget("kpi", {"aggregations": [{"fn": "avg", "col": "drops", "as": "value"}]})
    return rounded(_shown(spark, folder, widget), 9, "value")


@registered("D5 D9", f"SELECT round(sum(traffic), 2) AS value FROM {KPI_SQL}")
def widget_total_traffic(spark: SparkSession, folder: str) -> DataFrame:
    widget = _widget("kpi", {"aggregations": [{"fn": "sum", "col": "traffic", "as": "value"}]})
    return rounded(_shown(spark, folder, widget), 2, "value")


_PIVOT_COLUMNS = ", ".join(f"round(avg(traffic) FILTER (region = '{r}'), 9) AS \"{r}\"" for r in REGION_NAMES)


@registered("D1 D3 D4 D9", f"SELECT hour_ts, {_PIVOT_COLUMNS} FROM {KPI_SQL} GROUP BY hour_ts")
def widget_traffic_lines(spark: SparkSession, folder: str) -> DataFrame:
    widget = _widget(
        "line",
        {
            "aggregations": [{"fn": "avg", "col": "traffic", "as": "traffic"}],
            "groupBy": ["hour_ts", "region"],
            "sort": [{"col": "hour_ts"}],
        },
    )
    return rounded(_shown(spark, folder, widget, REGION_NAMES), 9, *REGION_NAMES)


@registered("D4 series found in the rows", f"SELECT hour_ts, {_PIVOT_COLUMNS} FROM {KPI_SQL} GROUP BY hour_ts")
def pivot_found_series(spark: SparkSession, folder: str) -> DataFrame:
    spec = QuerySpec.from_json(
        {
            "table": "kpi",
            "aggregations": [{"fn": "avg", "col": "traffic", "as": "traffic"}],
            "groupBy": ["hour_ts", "region"],
        }
    )
    rows = unpaged(kpi_feed(spark, folder), spec)
    return rounded(pivot_series(rows, "hour_ts", "region", "traffic"), 9, *REGION_NAMES)


@registered("D7 D9", f"SELECT region, round(avg(drops), 9) AS drop_rate FROM {KPI_SQL} GROUP BY region")
def widget_drop_bars(spark: SparkSession, folder: str) -> DataFrame:
    widget = _widget(
        "bar",
        {
            "aggregations": [{"fn": "avg", "col": "drops", "as": "drop_rate"}],
            "groupBy": ["region"],
            "sort": [{"col": "region", "dir": "asc"}],
        },
    )
    return rounded(_shown(spark, folder, widget), 9, "drop_rate")


@registered(
    "D7 D9 pie with shares",
    f"SELECT region, count(*) AS value, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM {KPI_SQL} GROUP BY region",
)
def widget_region_pie(spark: SparkSession, folder: str) -> DataFrame:
    widget = _widget("pie", {"aggregations": [{"fn": "count", "as": "value"}], "groupBy": ["region"], "sort": [{"col": "region"}]})
    return rounded(shares(_shown(spark, folder, widget), "value"), 8, "share")


@registered(
    "D6 D9 O4",
    f"""SELECT cell_id, round(sum(traffic), 2) AS traffic, round(sum(drops), 2) AS drops FROM {KPI_SQL} GROUP BY cell_id
    ORDER BY sum(traffic) DESC, cell_id LIMIT 25""",
)
def widget_cell_table(spark: SparkSession, folder: str) -> DataFrame:
    widget = _widget(
        "table",
        {
            "aggregations": [
                {"fn": "sum", "col": "traffic", "as": "traffic"},
                {"fn": "sum", "col": "drops", "as": "drops"},
                # Half-filled editor state is dropped.
                {"fn": "sum", "as": "unfinished"},
            ],
            "groupBy": ["cell_id"],
            "sort": [{"col": "traffic", "dir": "desc"}, {"col": "cell_id"}, {"dir": "asc"}],
            "limit": 25,
        },
    )
    return rounded(_shown(spark, folder, widget), 2, "traffic", "drops")


@registered("D7 scatter", f"SELECT traffic, drops FROM {KPI_SQL} WHERE drops > 50 ORDER BY event_id LIMIT 1000")
def widget_scatter(spark: SparkSession, folder: str) -> DataFrame:
    widget = _widget(
        "scatter",
        {
            "columns": ["traffic", "drops"],
            "filters": [{"col": "drops", "op": ">", "value": 50}],
            "sort": [{"col": "event_id"}],
        },
    )
    return _shown(spark, folder, widget)


@registered(
    "D1 D2 D9 F18 a whole dashboard from the store, with a shared filter",
    f"""SELECT 'bars' AS widget, region AS x, round(avg(traffic), 9) AS y FROM {KPI_SQL} WHERE region IN ('view', 'click') GROUP BY region
    UNION ALL SELECT 'calls', 'all', count(*) FROM {KPI_SQL} WHERE region IN ('view', 'click')
    UNION ALL SELECT 'sites', 'all', count(*) FROM customer""",
)
def dashboard_run(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "board")
    load_frame(store, "kpi", kpi_feed(spark, folder), "full")
    load_frame(store, "sites", table(spark, folder, "customer"), "full")
    count = {"aggregations": [{"fn": "count", "as": "value"}]}
    bars = {"aggregations": [{"fn": "avg", "col": "traffic", "as": "traffic"}], "groupBy": ["region"]}
    board = Dashboard.from_json(
        {
            "widgets": [
                {"id": "bars", "type": "bar", "source": {"table": "kpi"}, "query": bars},
                {"id": "calls", "type": "kpi", "source": {"table": "kpi"}, "query": count},
                {"id": "sites", "type": "kpi", "source": {"table": "sites"}, "query": count},
            ]
        }
    )
    shown = run_dashboard(store, board, [Filter("region", "in", ["view", "click"])])
    bar_rows = shown["bars"].data.select(F.lit("bars").alias("widget"), F.col("region").alias("x"), F.round("traffic", 9).alias("y"))
    tiles = [
        shown[name].data.select(F.lit(name).alias("widget"), F.lit("all").alias("x"), F.col("value").alias("y"))
        for name in ("calls", "sites")
    ]
    return bar_rows.unionByName(tiles[0]).unionByName(tiles[1])


@registered(
    "F18 cascading filters",
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY o_orderstatus",
)
def cascading_filter(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    spec = QuerySpec.from_json({"table": "orders", "groupBy": ["o_orderstatus"], "aggregations": [{"fn": "count", "as": "n"}]})
    shared = [Filter("o_totalprice", ">", 50000), Filter("region", "=", "North")]
    return apply_query(orders, cascaded(spec, shared, orders.columns))


# --- sites and maps ----------------------------------------------------------------------------


def _sites(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier, nation and region as the site dimension, with made coordinates."""
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    sites = table(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return sites.select(
        F.col("s_suppkey").alias("site"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
        (F.col("s_nationkey") * 3.5 - 40).alias("lat"),
        (F.col("s_suppkey") % 360 - 180).cast("double").alias("lon"),
    )


SITES_SQL = """(SELECT s_suppkey AS site, n_name AS nation, r_name AS region, s_nationkey * 3.5 - 40 AS lat,
    CAST(s_suppkey % 360 - 180 AS DOUBLE) AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@registered(
    "J3",
    f"""SELECT region, nation, count(*) AS n, round(sum(l_quantity), 2) AS quantity
    FROM lineitem LEFT JOIN {SITES_SQL} ON l_suppkey = site GROUP BY region, nation""",
)
def facts_with_sites(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("site"), "l_quantity")
    joined = with_sites(site_totals(facts, "site", "l_quantity"), _sites(spark, folder), "site")
    totals = joined.groupBy("region", "nation").agg(F.sum("points").alias("n"), F.sum("weight").alias("quantity"))
    return rounded(totals, 2, "quantity")


@registered(
    "D8 J3",
    f"""SELECT CAST(floor(lat / 5.0) AS BIGINT) AS lat_cell, CAST(floor(lon / 5.0) AS BIGINT) AS lon_cell, count(*) AS points, round(sum(l_quantity), 2) AS weight
    FROM lineitem JOIN {SITES_SQL} ON l_suppkey = site WHERE lat BETWEEN -30 AND 40 AND lon BETWEEN -180 AND 60 GROUP BY 1, 2""",
)
def map_grid(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("site"), "l_quantity")
    joined = with_sites(site_totals(facts, "site", "l_quantity"), _sites(spark, folder), "site")
    return rounded(map_cells(joined, "lat", "lon", 5.0, "weight", (-30, -180, 40, 60), "points"), 2, "weight")


@registered(
    "D8 map widget",
    f"SELECT lat, lon, count(*) AS sites, nation FROM {SITES_SQL} GROUP BY lat, lon, nation",
)
def widget_site_map(spark: SparkSession, folder: str) -> DataFrame:
    widget = _widget(
        "map",
        {
            "groupBy": ["lat", "lon", "nation"],
            "aggregations": [{"fn": "count", "as": "sites"}],
        },
        {"lat": "lat", "lon": "lon", "weight": "sites", "tooltip": ["nation"]},
    )
    return shape(widget, unpaged(_sites(spark, folder), widget.query))


@registered("D5 no rows give no value", "SELECT CAST(NULL AS DOUBLE) AS value")
def widget_without_rows(spark: SparkSession, folder: str) -> DataFrame:
    widget = _widget(
        "kpi",
        {
            "aggregations": [{"fn": "avg", "col": "traffic", "as": "value"}],
            "filters": [{"col": "traffic", "op": "<", "value": -1e9}],
        },
    )
    return _shown(spark, folder, widget)


@registered("F1 A9 C8 two-level", "SELECT region, count(DISTINCT hour_ts) AS hours FROM " + KPI_SQL + " GROUP BY region")
def hours_per_region(spark: SparkSession, folder: str) -> DataFrame:
    return whole(
        kpi_feed(spark, folder),
        groupBy=["region"],
        aggregations=[{"fn": "count_distinct", "col": "hour_ts", "as": "hours"}],
    )
