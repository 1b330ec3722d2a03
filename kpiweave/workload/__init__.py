"""Registered queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None
    covers: str


REGISTERED: dict[str, Entry] = {}


def registered(covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name."""

    def add(run: Run) -> Run:
        REGISTERED[run.__name__] = Entry(run, sql, covers)
        return run

    return add


def all_entries() -> dict[str, Entry]:
    from kpiweave.workload import boards, loading, reads, reading_sources, selects  # noqa: F401

    return dict(REGISTERED)
