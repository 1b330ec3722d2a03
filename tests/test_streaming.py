from __future__ import annotations

from datetime import datetime

import pytest

from kpiweave.plans.runs import run_log
from kpiweave.sources.landing import land
from kpiweave.sources.registry import Surroundings
from kpiweave.specs import JobSource, JobSpec, LoadCommand, Schedule
from kpiweave.streaming.landing_stream import append_batches, landed_stream
from kpiweave.streaming.load_queue import apply_commands, command_stream, enqueue, extract_and_enqueue, queue_dir

from .conftest import rows_of

SCHEMA = "k string, v int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA).repartition(3)


def put(store, run_id, frame, mode="upsert"):
    path = store.landing_path("t", run_id)
    land(frame, path)
    enqueue(store, LoadCommand(run_id, "t", mode, path, key_columns=("k",)))


def drain(store, per_trigger=100, **kwargs):
    query = apply_commands(store, command_stream(store, per_trigger), **kwargs)
    query.awaitTermination(120)
    assert query.exception() is None


@pytest.mark.parametrize("per_trigger", [1, 100])
def test_commands_apply_in_order_and_resume(spark, store, per_trigger):
    put(store, "a", rows(spark, ("A", 1), ("B", 1), (None, 1)))
    put(store, "b", rows(spark, ("B", 2), ("B", 3), ("C", 2), (None, 2)))
    seen = []
    drain(store, per_trigger, on_load=seen.append)
    assert [r.table_version for r in seen] == [1, 2]
    # A run is applied as a whole: its own duplicates stay although they lie in several files.
    assert rows_of(store.read("t")) == [("A", 1), ("B", 2), ("B", 3), ("C", 2), (None, 1), (None, 2)]
    put(store, "c", rows(spark, ("A", 3)))
    drain(store, per_trigger, on_load=seen.append)
    assert len(seen) == 3 and ("A", 3) in rows_of(store.read("t"))


def test_a_queue_read_again_changes_nothing(spark, store):
    put(store, "a", rows(spark, ("A", 1)), "append")
    put(store, "b", rows(spark, ("A", 1)), "append")
    for attempt in ("one", "two"):
        # A lost checkpoint makes the queue start over.
        drain(store, checkpoint=f"{store.root}/check-{attempt}")
    assert store.read("t").count() == 2 and store.versions("t") == [1, 2]


def test_bad_messages_and_failing_loads_are_passed_over(spark, store):
    put(store, "a", rows(spark, ("A", 1)), "append")
    store.files.create(f"{queue_dir(store)}/{'9' * 20}-x.json", "{not json")
    put(store, "b", spark.range(2), "append")
    put(store, "c", rows(spark, ("C", 1)), "append")
    errors = []
    drain(store, on_error=lambda name, error: errors.append(type(error).__name__))
    assert sorted(errors) == ["JSONDecodeError", "SchemaDrift"]
    assert rows_of(store.read("t")) == [("A", 1), ("C", 1)]
    assert sorted(r.status for r in run_log(store).collect()) == ["failed", "success", "success"]


def test_jobs_through_the_queue(spark, store):
    columns = ("timestamp", "cell_id", "region", "traffic_erl")
    for name in ("a", "b"):
        job = JobSpec(name, JobSource("synthetic", columns=columns), name, Schedule(every="1h"), "full")
        extract_and_enqueue(store, job, Surroundings(as_of=datetime(2024, 5, 5)))
    assert store.tables() == []  # nothing is readable before its load
    drain(store)
    assert [store.manifest(t).row_count for t in store.tables()] == [588, 588]


def test_two_streams_into_one_table(spark, store):
    for name in ("x", "y"):
        frame = rows(spark, (name, 1), (name, 2))
        land(frame, f"{store.root}/in-{name}/1")
        for _ in range(2):  # the second finds nothing new
            stream = landed_stream(store, f"{store.root}/in-{name}", frame.schema)
            append_batches(store, "t", stream, checkpoint=f"{store.root}/check-{name}").awaitTermination(120)
    assert rows_of(store.read("t")) == [("x", 1), ("x", 2), ("y", 1), ("y", 2)]


def test_a_failing_load_is_tried_again_and_then_kept(spark, store, monkeypatch):
    from kpiweave.streaming import load_queue

    put(store, "a", rows(spark, ("A", 1)), "append")
    calls, waits, real = [], [], load_queue.load

    def shaky(inside, command, options, **more):
        calls.append(command.run_id)
        if len(calls) < 3:
            raise OSError("no answer")
        return real(inside, command, options, **more)

    monkeypatch.setattr(load_queue, "load", shaky)
    apply_commands(store, command_stream(store), checkpoint=f"{store.root}/c1", sleep=waits.append).awaitTermination(120)
    assert len(calls) == 3 and waits == [1.0, 2.0] and store.read("t").count() == 1
    put(store, "b", rows(spark, ("B", 1)), "append")
    monkeypatch.setattr(load_queue, "load", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
    apply_commands(store, command_stream(store), checkpoint=f"{store.root}/c1", sleep=waits.append, tries=2).awaitTermination(120)
    assert len(store.files.children(load_queue.dead_letters(store))) == 1


def test_appended_micro_batches(spark, store):
    frame = rows(spark, ("A", 1), ("B", 1), ("C", 2))
    land(frame, f"{store.root}/incoming/1")
    for _ in ("one", "again"):
        stream = landed_stream(store, f"{store.root}/incoming", frame.schema)
        append_batches(store, "t", stream, checkpoint=f"{store.root}/check").awaitTermination(120)
    assert rows_of(store.read("t")) == [("A", 1), ("B", 1), ("C", 2)]
    # A new checkpoint is another stream: it reads everything, and nothing of it is dropped.
    stream = landed_stream(store, f"{store.root}/incoming", frame.schema)
    append_batches(store, "t", stream, checkpoint=f"{store.root}/other").awaitTermination(120)
    assert store.read("t").count() == 6
