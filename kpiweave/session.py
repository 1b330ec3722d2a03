"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change results or plans. Cluster sizing stays with the cluster.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Deep pages: above a million rows a distributed sort replaces the per-task heap.
    "spark.sql.execution.topKSortFallbackThreshold": "1000000",
    "spark.sql.parquet.aggregatePushdown": "true",
}

# User SELECTs quote identifiers with double quotes, as standard SQL does.
TRANSFORM_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "kpiweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine settings; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def transform_session(spark: SparkSession) -> SparkSession:
    """A sibling session (own settings and temp views) for user SELECTs."""
    sibling = spark.newSession()
    for key, value in TRANSFORM_CONF.items():
        sibling.conf.set(key, value)
    return sibling


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where the cluster names none (tests on one machine) a local folder is
    made and recorded, so that later calls agree on it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kpiweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path under the shared folder."""
    return f"{shared_folder(spark)}/kpiweave/{label}-{uuid.uuid4().hex[:12]}"
