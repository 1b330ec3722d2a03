"""Sources and inference: CSV, landing, synthetic feed, previews, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiweave.plans.loads import load_csv, load_frame, preview_sql, run_job
from kpiweave.session import scratch_path
from kpiweave.sources.csv_files import checked_rows, infer_csv, read_csv, rejects_by_reason
from kpiweave.sources.landing import land
from kpiweave.sources.registry import Surroundings, preview_source, profile, validate_source
from kpiweave.sources.synthetic import REGIONS, metrics_on
from kpiweave.specs import Filter, JobSource, JobSpec, Schedule
from kpiweave.workload import registered
from kpiweave.workload.frames import new_store, rounded, table


def written_csv(spark: SparkSession, frame: DataFrame, label: str, **options) -> str:
    path = scratch_path(spark, label)
    frame.write.options(**{"header": True, **options}).csv(path)
    return path


@registered("S1 S2 I1", "SELECT * FROM orders")
def csv_read_back(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, written_csv(spark, table(spark, folder, "orders"), "csv"))


@registered(
    "S1 S2 other delimiter, chosen columns",
    "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
)
def csv_semicolon(spark: SparkSession, folder: str) -> DataFrame:
    path = written_csv(spark, table(spark, folder, "part"), "csv-semicolon", sep=";")
    return read_csv(spark, path, ["p_partkey", "p_name", "p_size", "p_retailprice"])


@registered(
    "S16 files and folders in one load",
    """SELECT name, kind FROM (SELECT c_name AS name, 'customer' AS kind FROM customer
      UNION ALL SELECT s_name, 'supplier' FROM supplier)""",
)
def csv_many_files(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    paths = [written_csv(spark, customers, "csv-many"), written_csv(spark, suppliers, "csv-many")]
    return read_csv(spark, paths)


@registered(
    "I1 I2 S2 inferred names, types and row count",
    """SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'),
      ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) t(column_name, column_type),
      (SELECT count(*) AS rows FROM orders)""",
)
def csv_inferred_schema(spark: SparkSession, folder: str) -> DataFrame:
    schema = infer_csv(spark, written_csv(spark, table(spark, folder, "orders"), "csv-infer"))
    rows = [(c.name, c.type, schema.row_estimate) for c in schema.columns]
    return spark.createDataFrame(rows, "column_name string, column_type string, rows bigint")


def _damaged(spark: SparkSession, folder: str) -> str:
    """Customers as text lines; those in debt lack a field or carry a bad number."""
    broken = F.col("c_acctbal") < 0
    line = F.when(
        broken & (F.col("c_mktsegment") == "BUILDING"), F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name")
    ).otherwise(
        F.concat_ws(
            ",",
            F.col("c_custkey").cast("string"),
            "c_name",
            F.when(broken, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")),
        )
    )
    path = scratch_path(spark, "csv-damaged")
    lines = table(spark, folder, "customer").select(line.alias("value"))
    # Every part file needs the header line of its own.
    lines.write.option("header", True).option("quote", "").csv(path)
    return path


@registered(
    "S17 I4 rejects by reason",
    """SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'wrong number of fields' ELSE 'balance is not double' END AS reason,
      count(*) AS rows FROM customer WHERE c_acctbal < 0 GROUP BY 1""",
)
def csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    _, bad = _judged(spark, folder)
    return rejects_by_reason(bad).groupBy("reason").agg(F.sum("rows").alias("rows"))


@registered("S17 I4 good rows", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal >= 0")
def csv_good_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder)[0]


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from kpiweave.sources.csv_files import Dialect, InferredColumn, InferredSchema

    columns = (InferredColumn("id", "string"), InferredColumn("name", "string"), InferredColumn("balance", "string"))
    schema = InferredSchema(columns, dialect=Dialect(",", True, ("id", "name", "balance")))
    return checked_rows(spark, _damaged(spark, folder), {"id": "bigint", "balance": "double"}, schema)


@registered("L19", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def csv_into_table(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "csv-table")
    load_csv(store, written_csv(spark, table(spark, folder, "supplier"), "csv-load"), "suppliers")
    return store.read("suppliers")


def _csv_job(mode: str = "full", keys: tuple[str, ...] = ()) -> JobSpec:
    return JobSpec(
        name="load_orders_csv",
        source=JobSource(
            kind="csv",
            upload_id="u1",
            columns=("o_orderkey", "o_orderstatus", "o_totalprice"),
            filters=(Filter("o_orderstatus", "in", ["F", "O"]),),
        ),
        target_table="orders_csv",
        schedule=Schedule(every="1d"),
        load_mode=mode,
        key_columns=keys,
    )


@registered(
    "S13 F15 F16 F19 a CSV job end to end",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')",
)
def csv_job(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "csv-job")
    around = Surroundings(uploads={"u1": written_csv(spark, table(spark, folder, "orders"), "csv-job")})
    run_job(store, _csv_job("upsert", ("o_orderkey",)), around)
    return store.read("orders_csv")


@registered(
    "S20",
    "SELECT * FROM (VALUES ('o_orderkey'), ('o_orderstatus'), ('o_totalprice')) t(column_name), (SELECT count(*) AS previewed FROM (SELECT 1 FROM orders LIMIT 20))",
)
def csv_job_checked(spark: SparkSession, folder: str) -> DataFrame:
    around = Surroundings(uploads={"u1": written_csv(spark, table(spark, folder, "orders"), "csv-check")})
    checked = validate_source(spark, _csv_job(), around)
    shown = preview_source(spark, _csv_job(), around).agg(F.count(F.lit(1)).alias("previewed"))
    names = spark.createDataFrame([(c,) for c in checked.columns], "column_name string")
    return names.withColumn("one", F.lit(1)).join(shown.withColumn("one", F.lit(1)), "one").drop("one")


@registered(
    "S8 S15 landing write and scan",
    "SELECT event_type, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY event_type",
)
def landed_and_scanned(spark: SparkSession, folder: str) -> DataFrame:
    landed = land(table(spark, folder, "events"), scratch_path(spark, "landing"), "ts")
    rows = spark.read.schema(landed.schema).parquet(landed.path)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@registered(
    "S15 A13 count and mark observed while writing",
    "SELECT count(*) AS rows_read, max(ts) AS mark FROM events",
)
def landed_facts(spark: SparkSession, folder: str) -> DataFrame:
    landed = land(table(spark, folder, "events"), scratch_path(spark, "landing"), "ts")
    facts = spark.createDataFrame([(landed.rows_read, landed.new_watermark)], "rows_read bigint, mark string")
    return facts.withColumn("mark", F.col("mark").cast("timestamp_ntz"))


@registered(
    "S18 export as job target",
    "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment",
)
def exported_files(spark: SparkSession, folder: str) -> DataFrame:
    from kpiweave.plans.exports import export_table

    store = new_store(spark, "export")
    load_frame(store, "customer", table(spark, folder, "customer"), "full")
    path = scratch_path(spark, "exported")
    export_table(store, "customer", path, "csv")
    rows = read_csv(spark, path)
    sums = rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance"))
    return rounded(sums, 2, "balance")


@registered(
    "S7 the generator over the feed's own cells and hours",
    """SELECT region, count(*) AS n, min(hour_ts) AS first_hour, max(hour_ts) AS last_hour, count(*) AS in_range FROM (
      SELECT hour_ts, user_id, CASE user_id % 4 WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East' ELSE 'West' END AS region
      FROM (SELECT DISTINCT date_trunc('hour', ts) AS hour_ts, user_id FROM events)) GROUP BY region""",
)
def synthetic_feed(spark: SparkSession, folder: str) -> DataFrame:
    hours = table(spark, folder, "events").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"), "user_id"
    ).distinct()
    region = F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (F.col("user_id") % 4 + 1).cast("int"))
    grid = hours.select("timestamp", F.format_string("CELL_%04d", "user_id").alias("cell_id"), region.alias("region"))
    rows = metrics_on(grid, ["timestamp", "cell_id", "region", "traffic_erl", "drop_rate", "throughput_mbps", "latency_ms"])
    sane = (F.col("traffic_erl") >= 0) & (F.col("drop_rate") >= 0) & (F.col("throughput_mbps") >= 0) & (F.col("latency_ms") >= 1)
    return rows.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("first_hour"),
        F.max("timestamp").alias("last_hour"),
        F.count_if(sane).alias("in_range"),
    )


@registered("S12", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 200")
def sql_preview(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "preview")
    load_frame(store, "customer", table(spark, folder, "customer"), "full")
    return preview_sql(store, 'SELECT "c_custkey", "c_name" FROM customer ORDER BY "c_acctbal" DESC, c_custkey')


@registered("S10 sample size", "SELECT count(*) AS n FROM (SELECT 1 FROM customer LIMIT 20)")
def table_sample(spark: SparkSession, folder: str) -> DataFrame:
    store = new_store(spark, "sample")
    load_frame(store, "customer", table(spark, folder, "customer"), "full")
    return store.sample("customer").agg(F.count(F.lit(1)).alias("n"))


@registered(
    "A14 I1",
    """SELECT 'o_orderkey' AS column_name, 'bigint' AS column_type, count(*) AS rows, count(*) - count(o_orderkey) AS nulls FROM orders
    UNION ALL SELECT 'o_custkey', 'bigint', count(*), count(*) - count(o_custkey) FROM orders
    UNION ALL SELECT 'o_orderstatus', 'string', count(*), count(*) - count(o_orderstatus) FROM orders
    UNION ALL SELECT 'o_totalprice', 'double', count(*), count(*) - count(o_totalprice) FROM orders
    UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', count(*), count(*) - count(o_orderdate) FROM orders
    UNION ALL SELECT 'o_orderpriority', 'string', count(*), count(*) - count(o_orderpriority) FROM orders""",
)
def column_facts(spark: SparkSession, folder: str) -> DataFrame:
    return profile(table(spark, folder, "orders")).select("column_name", "column_type", "rows", "nulls")
