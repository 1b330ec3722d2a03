"""Loads into versioned tables: full, append, upsert, incremental, upkeep, streams."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiweave.operators.incremental import since
from kpiweave.operators.merge import latest_per_key
from kpiweave.operators.schemas import SchemaDrift
from kpiweave.plans.loads import LoadOptions, load, load_frame
from kpiweave.plans.maintain import apply_retention, compact, expire_landing, export_snapshot, import_snapshot, rebuild
from kpiweave.plans.runs import run_log
from kpiweave.plans.store import Layout, TableStore
from kpiweave.session import scratch_path
from kpiweave.sources.landing import land
from kpiweave.specs import Aggregation, Filter, LoadCommand, QuerySpec, Retention, WatermarkSpec
from kpiweave.streaming.landing_stream import append_batches, landed_stream
from kpiweave.streaming.load_queue import apply_commands, command_stream, enqueue
from kpiweave.workload import registered
from kpiweave.workload.frames import new_store, rounded, table

MARK = WatermarkSpec("ts")


def recalculated(spark: SparkSession, folder: str) -> DataFrame:
    """Orders recalculated from their lines: the batch of corrections."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"), F.max("l_shipdate").alias("o_orderdate")
    )
    return lines.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.lit(None).cast("bigint").alias("o_custkey"),
        F.lit("R").alias("o_orderstatus"),
        "o_totalprice",
        "o_orderdate",
        F.lit("0-RECALCULATED").alias("o_orderpriority"),
    )


RECALCULATED_SQL = """(SELECT l_orderkey AS o_orderkey, CAST(NULL AS BIGINT) AS o_custkey, 'R' AS o_orderstatus,
    round(sum(l_extendedprice), 2) AS o_totalprice, max(l_shipdate) AS o_orderdate, '0-RECALCULATED' AS o_orderpriority
  FROM lineitem GROUP BY l_orderkey)"""
UPSERT_SQL = f"""SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT * FROM {RECALCULATED_SQL}"""


@registered("L1 schema replaced", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def load_full(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "full")
    load_frame(store, "parties", table(spark, folder, "customer"), "full")
    load_frame(store, "parties", table(spark, folder, "supplier"), "full")
    return store.read("parties")


def _parties(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, folder, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")
    )
    suppliers = table(spark, folder, "supplier").select(
        # Another column order: a batch is aligned by name.
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")
    )
    return customers, suppliers


PARTIES_SQL = """SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer
  UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier"""


@registered("L2 U1", PARTIES_SQL)
def load_append(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "append")
    for batch in _parties(spark, folder):
        load_frame(store, "parties", batch, "append")
    return store.read("parties")


@registered("L2 replays add rows again", f"SELECT name, count(*) AS n FROM ({PARTIES_SQL} UNION ALL {PARTIES_SQL}) GROUP BY name")
def load_append_again(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "append-again")
    for _ in range(2):
        for batch in _parties(spark, folder):
            load_frame(store, "parties", batch, "append")
    return store.read("parties").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@registered("L9 a run id is taken once", PARTIES_SQL)
def load_append_once(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "append-once")
    for _ in range(2):
        for i, batch in enumerate(_parties(spark, folder)):
            load_frame(store, "parties", batch, "append", run_id=f"run-{i}", options=LoadOptions(exactly_once=True))
    return store.read("parties")


def _upserted(spark: SparkSession, folder: str, label: str, layout: Layout | None = None) -> TableStore:
    store = new_store(spark, label)
    keys = ("o_orderkey",)
    options = LoadOptions(layout=layout)
    load_frame(store, "kpi_orders", table(spark, folder, "orders"), "upsert", keys, options=options)
    load_frame(store, "kpi_orders", recalculated(spark, folder), "upsert", keys, options=options)
    return store


@registered("L3 J1 U2", UPSERT_SQL)
def load_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _upserted(spark, folder, "upsert").read("kpi_orders")


@registered("L3 over key buckets", UPSERT_SQL)
def load_upsert_buckets(spark: SparkSession, folder: str) -> DataFrame:
    layout = Layout(buckets=8, keys=("o_orderkey",))
    return _upserted(spark, folder, "upsert-buckets", layout).read("kpi_orders")


@registered("L9 the same batch twice is once", UPSERT_SQL)
def load_upsert_replayed(spark: SparkSession, folder: str) -> DataFrame:
    store = _upserted(spark, folder, "upsert-replayed")
    load_frame(store, "kpi_orders", recalculated(spark, folder), "upsert", ("o_orderkey",))
    return store.read("kpi_orders")


@registered(
    "L3 only touched days are rewritten",
    """SELECT event_id, ts, user_id, event_type, CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN value * 2 ELSE value END AS value, props
    FROM events""",
)
def load_upsert_days(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "upsert-days")
    events = table(spark, folder, "events")
    keys = ("event_id", "ts")
    load_frame(store, "feed", events, "upsert", keys, MARK)
    late = events.filter(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz"))
    load_frame(store, "feed", late.withColumn("value", F.col("value") * 2), "upsert", keys, MARK)
    return store.read("feed")


@registered(
    "L3 NULL keys never match; batch duplicates stay",
    """SELECT failing_cell, CAST(sum(copies) AS BIGINT) AS n FROM (
      SELECT CASE WHEN event_type = 'error' THEN user_id END AS failing_cell,
        CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS copies FROM events) GROUP BY failing_cell""",
)
def load_upsert_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "upsert-nulls")
    cell = F.when(F.col("event_type") == "error", F.col("user_id")).alias("failing_cell")
    rows = table(spark, folder, "events").select(cell, "ts", "value")
    for _ in range(2):
        load_frame(store, "feed", rows, "upsert", ("failing_cell",))
    return store.read("feed").groupBy("failing_cell").agg(F.count(F.lit(1)).alias("n"))


@registered(
    "L3 newest row per key",
    """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value
    FROM events GROUP BY user_id, event_type""",
)
def load_upsert_deduped(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "upsert-deduped")
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value")
    load_frame(store, "feed", rows, "upsert", ("user_id", "event_type"), options=LoadOptions(dedupe_by="event_id"))
    return store.read("feed")


@registered(
    "L5 L6 A12 load facts",
    """SELECT 1 AS version, 'upsert' AS load_mode, count(*) AS rows_written, count(*) AS row_count FROM orders
    UNION ALL SELECT 2, 'upsert', (SELECT count(DISTINCT l_orderkey) FROM lineitem), count(*) FROM orders""",
)
def load_results(spark: SparkSession, folder: str) -> DataFrame:
    store = _upserted(spark, folder, "results")
    rows = [(m.version, m.load_mode, m.rows_written, m.row_count) for m in store.history("kpi_orders")]
    return spark.createDataFrame(rows, "version int, load_mode string, rows_written bigint, row_count bigint")


@registered(
    "L7",
    """SELECT 1 AS version, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 2, o_orderstatus, count(*) FROM (""" + UPSERT_SQL + ") GROUP BY o_orderstatus",
)
def read_pinned_versions(spark: SparkSession, folder: str) -> DataFrame:
    store = _upserted(spark, folder, "pinned")
    frames = []
    for version in (1, 2):
        spec = QuerySpec(
            "kpi_orders",
            group_by=("o_orderstatus",),
            aggregations=(Aggregation("count", None, "n"),),
            table_version_pin=version,
        )
        frames.append(store.query(spec).rows.select(F.lit(version).alias("version"), "o_orderstatus", "n"))
    return frames[0].unionByName(frames[1])


@registered(
    "L8 A13",
    "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value, max(ts) AS last_ts FROM events GROUP BY event_type",
)
def load_incremental(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "incremental")
    events = table(spark, folder, "events")
    first = events.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    load_frame(store, "feed", first, "append", watermark=MARK)
    for _ in range(2):
        # The second pass finds nothing after the mark.
        fresh = since(events, "ts", store.manifest("feed").watermark_value)
        load_frame(store, "feed", fresh, "append", watermark=MARK)
    totals = store.read("feed").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.max("ts").alias("last_ts")
    )
    return rounded(totals, 2, "value")


TRANSFORM = """SELECT "c_mktsegment" AS segment, count(*) AS orders, round(sum(o."o_totalprice"), 2) AS total
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY "c_mktsegment" """


@registered("L10 S9 X1 X3", TRANSFORM)
def load_transform(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "transform")
    load_frame(store, "orders", table(spark, folder, "orders"), "full")
    load_frame(store, "customer", table(spark, folder, "customer"), "full")
    load(store, LoadCommand("by-segment", "segment_totals", "full", transform_sql=TRANSFORM + ";"))
    return store.read("segment_totals")


@registered(
    "L11 run records",
    """SELECT * FROM (VALUES ('kpi_orders', 'failed', CAST(0 AS BIGINT)), ('kpi_orders', 'success', (SELECT count(*) FROM orders)),
      ('kpi_orders', 'success', (SELECT count(DISTINCT l_orderkey) FROM lineitem))) t(table_name, status, rows_written)""",
)
def load_runs(spark: SparkSession, folder: str) -> DataFrame:
    store = _upserted(spark, folder, "runs")
    try:
        load_frame(store, "kpi_orders", table(spark, folder, "part"), "append")
    except SchemaDrift:
        pass  # recorded as a failed run
    return run_log(store).select("table_name", "status", "rows_written")


@registered("L4 a failed load changes nothing", UPSERT_SQL)
def load_failure_leaves_table(spark: SparkSession, folder: str) -> DataFrame:
    store = _upserted(spark, folder, "failure")
    try:
        load_frame(store, "kpi_orders", table(spark, folder, "part"), "append")
    except SchemaDrift:
        pass
    return store.read("kpi_orders")


@registered(
    "L13",
    "SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY",
)
def retention_window(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "retention")
    load_frame(store, "feed", table(spark, folder, "events"), "append", watermark=MARK)
    newest = datetime.fromisoformat(store.manifest("feed").watermark_value)
    apply_retention(store, "feed", Retention(window_days=10), newest)
    return store.read("feed")


@registered("L14", "SELECT * FROM events")
def compaction(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "compaction")
    events = table(spark, folder, "events")
    for kind in ("view", "click", "purchase", "signup", "error"):
        load_frame(store, "feed", events.filter(F.col("event_type") == kind), "append", watermark=MARK)
    compact(store, "feed")
    return store.read("feed")


@registered("L15", UPSERT_SQL)
def rebuild_from_landing(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "rebuild")
    orders = table(spark, folder, "orders")
    load_frame(store, "kpi_orders", orders.withColumn("o_orderstatus", F.lit("X")), "full", ("o_orderkey",))
    load_frame(store, "kpi_orders", orders, "upsert", ("o_orderkey",))
    load_frame(store, "kpi_orders", recalculated(spark, folder), "upsert", ("o_orderkey",))
    rebuild(store, "kpi_orders", into="rebuilt")
    return store.read("rebuilt")


@registered("L16", UPSERT_SQL)
def snapshot_restored(spark: SparkSession, folder: str) -> DataFrame:
    store = _upserted(spark, folder, "snapshot")
    target = scratch_path(spark, "snapshot-copy")
    export_snapshot(store, target)
    other = new_store(spark, "restored")
    import_snapshot(other, target)
    return other.read("kpi_orders")


@registered("L15 L16 rebuild after a restore", "SELECT o_orderkey, o_totalprice FROM orders")
def rebuild_after_restore(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "restored")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    odd = F.col("o_orderkey") % 2 == 1
    load_frame(store, "orders", orders.where(odd), "append")
    export_snapshot(store, f"{store.root}/snapshot")
    import_snapshot(store, f"{store.root}/snapshot")
    load_frame(store, "orders", orders.where(~odd), "append")
    rebuild(store, "orders")
    return store.read("orders")


@registered("L17 landed runs that no version is made of can go", "SELECT * FROM events")
def landing_expired(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "expiry")
    load_frame(store, "feed", table(spark, folder, "events"), "append", watermark=MARK)
    expire_landing(store, "feed", datetime.now() + timedelta(days=31), days=30)
    return store.read("feed")


@registered(
    "L18",
    """SELECT 'quarantined' AS place, count(*) AS n FROM part
    UNION ALL SELECT 'table', count(*) FROM orders""",
)
def drift_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "drift")
    load_frame(store, "kpi_orders", table(spark, folder, "orders"), "append")
    try:
        batch = table(spark, folder, "part")
        load_frame(store, "kpi_orders", batch, "append", run_id="bad", options=LoadOptions(on_drift="quarantine"))
    except SchemaDrift:
        pass  # the batch is set aside
    aside = spark.read.parquet(f"{store.root}/quarantine/kpi_orders/_run=bad/rows")
    count = F.count(F.lit(1)).alias("n")
    kept = store.read("kpi_orders").agg(count).select(F.lit("table").alias("place"), "n")
    return aside.agg(count).select(F.lit("quarantined").alias("place"), "n").unionByName(kept)


def _queued(spark: SparkSession, folder: str, label: str, per_trigger: int) -> DataFrame:
    store = new_store(spark, label)
    for i, rows in enumerate((table(spark, folder, "orders"), recalculated(spark, folder))):
        path = store.landing_path("kpi_orders", f"run-{i}")
        land(rows, path)
        enqueue(store, LoadCommand(f"run-{i}", "kpi_orders", "upsert", path, key_columns=("o_orderkey",)))
    apply_commands(store, command_stream(store, per_trigger)).awaitTermination()
    return store.read("kpi_orders")


@registered("T1 T3 load queue", UPSERT_SQL)
def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _queued(spark, folder, "stream", 1)


@registered("T1 commands of one micro-batch keep their order", UPSERT_SQL)
def stream_upsert_one_batch(spark: SparkSession, folder: str) -> DataFrame:
    return _queued(spark, folder, "stream-one", 100)


@registered("T1 append", "SELECT * FROM events")
def stream_append(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "stream-append")
    events = table(spark, folder, "events")
    land(events, f"{store.root}/incoming/1")
    stream = landed_stream(store, f"{store.root}/incoming", events.schema)
    append_batches(store, "feed", stream, MARK).awaitTermination()
    return store.read("feed")


@registered(
    "L7 F7 a day filter reads only its days",
    "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-25' AND ts < TIMESTAMP '2024-01-28' GROUP BY event_type",
)
def query_pruned_days(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "pruned")
    load_frame(store, "feed", table(spark, folder, "events"), "append", watermark=MARK)
    spec = QuerySpec(
        "feed",
        group_by=("event_type",),
        aggregations=(Aggregation("count", None, "n"),),
        filters=(Filter("ts", ">=", "2024-01-25"), Filter("ts", "<", "2024-01-28")),
    )
    return store.query(replace(spec, include_sql=True)).rows


@registered(
    "L3 dedupe operator",
    "SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id",
)
def newest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", "ts", "event_id")
    return latest_per_key(rows, ["user_id"], "ts")
