"""Landed files appended to a table as they arrive.

Rows are independent of each other in an append, so a micro-batch may hold any files.
Upserts, where a run must be applied as a whole, go through ``load_queue``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kpiweave.functions.timing import interval_seconds
from kpiweave.plans.loads import LoadOptions, LoadResult, load_frame
from kpiweave.plans.store import TableStore
from kpiweave.specs import WatermarkSpec


def landed_stream(
    store: TableStore, folder: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Rows of newly landed files."""
    reader = store.spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def start(stream_writer, every: str | None) -> StreamingQuery:
    """Run at an interval ("15m", "1h"), or over what is waiting and then end."""
    if every:
        return stream_writer.trigger(processingTime=f"{interval_seconds(every)} seconds").start()
    return stream_writer.trigger(availableNow=True).start()


def append_batches(
    store: TableStore,
    table: str,
    stream: DataFrame,
    watermark: WatermarkSpec | None = None,
    checkpoint: str | None = None,
    every: str | None = None,
    on_load: Callable[[LoadResult], None] | None = None,
) -> StreamingQuery:
    """Start appending the stream's micro-batches to the table.

    A micro-batch becomes one load whose run id is the stream's own id, as its checkpoint
    keeps it, and the batch number. So a batch which Spark repeats after a failure changes
    nothing, and several streams into one table do not take each other's numbers. Give
    each of them its own checkpoint.
    """
    place = checkpoint or f"{store.root}/checkpoints/{table}"

    def apply(batch: DataFrame, batch_id: int) -> None:
        known = json.loads(batch.sparkSession.read.text(f"{place}/metadata").first()[0])["id"]
        result = load_frame(
            TableStore(batch.sparkSession, store.root),
            table,
            batch,
            "append",
            watermark=watermark,
            run_id=f"stream-{known}-{batch_id:010d}",
            job_name=f"stream_{table}",
            options=LoadOptions(exactly_once=True),
        )
        if on_load:
            on_load(result)

    writer = stream.writeStream.foreachBatch(apply).queryName(f"append_{table}_{uuid.uuid4().hex[:8]}")
    return start(writer.option("checkpointLocation", place), every)
