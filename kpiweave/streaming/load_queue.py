"""The load queue: one small message per landed run, applied in order.

Extracts land their rows and enqueue a load command; a stream over the queue folder
applies the commands. The stream's checkpoint is the queue position. Rows never pass
through the stream: a command names the landed directory, which is loaded as a whole.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kpiweave.operators.schemas import SchemaDrift
from kpiweave.plans.loads import LoadOptions, LoadResult, extract, load
from kpiweave.plans.store import TableStore, new_run_id
from kpiweave.sources.registry import Surroundings
from kpiweave.specs import JobSpec, LoadCommand, SpecError
from kpiweave.streaming.landing_stream import start

log = logging.getLogger(__name__)
MESSAGES_PER_TRIGGER = 100


def queue_dir(store: TableStore) -> str:
    return f"{store.root}/queue"


def dead_letters(store: TableStore) -> str:
    """Messages that could not be applied."""
    return f"{store.root}/queue_dead"


def enqueue(store: TableStore, command: LoadCommand) -> str:
    """Put a command at the end of the queue."""
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json"
    store.files.create(f"{queue_dir(store)}/{name}", json.dumps(command.to_json()))
    return name


def extract_and_enqueue(store: TableStore, job: JobSpec, around: Surroundings) -> LoadCommand:
    """Land what is new for a job and leave the load to the queue."""
    command, _ = extract(store, job, around, new_run_id())
    enqueue(store, command)
    return command


def command_stream(store: TableStore, per_trigger: int = MESSAGES_PER_TRIGGER) -> DataFrame:
    reader = store.spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", per_trigger)
    return reader.text(queue_dir(store)).select("value", F.col("_metadata.file_name").alias("name"))


def apply_commands(
    store: TableStore,
    stream: DataFrame,
    checkpoint: str | None = None,
    every: str | None = None,
    on_load: Callable[[LoadResult], None] | None = None,
    on_error: Callable[[str, Exception], None] | None = None,
    tries: int = 5,
    first_wait_s: float = 1.0,
    longest_wait_s: float = 600.0,
    sleep: Callable[[float], None] = time.sleep,
) -> StreamingQuery:
    """Start applying queued commands, oldest first.

    A load that fails is marked failed in the run log and tried again, up to ``tries`` times
    with waits that double; a batch or definition that cannot be loaded is not. A message that
    could not be applied is reported and kept in the dead-letter folder, and the queue goes on.
    A command repeated after a crash is recognised by its run id.
    """

    def report(name: str, error: Exception) -> None:
        log.error("load %s: %s", name, error)
        if on_error:
            on_error(name, error)

    def loaded(inside: TableStore, command: LoadCommand) -> LoadResult:
        for attempt in range(1, tries + 1):
            try:
                return load(inside, command, LoadOptions(exactly_once=True), attempt=attempt)
            except (SpecError, SchemaDrift, LookupError):
                raise
            except Exception:
                if attempt == tries:
                    raise
                sleep(min(longest_wait_s, first_wait_s * 2 ** (attempt - 1)))
        raise AssertionError("unreachable")

    def apply(batch: DataFrame, batch_id: int) -> None:
        inside = TableStore(batch.sparkSession, store.root)
        # Messages, not rows: at most the trigger's number of small texts.
        for message in batch.orderBy("name").collect():
            try:
                command = LoadCommand.from_json(json.loads(message["value"]))
                result = loaded(inside, command)
            except Exception as error:  # the queue outlives a bad command
                inside.files.put(f"{dead_letters(inside)}/{message['name']}", message["value"])
                report(message["name"], error)
                continue
            if on_load:
                on_load(result)

    writer = stream.writeStream.foreachBatch(apply).queryName("load_queue")
    return start(writer.option("checkpointLocation", checkpoint or f"{store.root}/checkpoints/queue"), every)
