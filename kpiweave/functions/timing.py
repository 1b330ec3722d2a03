"""Schedules and staleness as columns."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interval units in seconds, the default interval, the staleness factor.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
DEFAULT_INTERVAL_S = 3600
STALE_FACTOR = 2.0
EVERY = r"^\s*(\d+)\s*([smhd])\s*$"


def interval_seconds(every: str | None) -> int:
    """Seconds of "15m", "1h", "1d"; a cron or unknown text counts as an hour."""
    match = re.match(EVERY, every or "")
    return int(match[1]) * UNIT_SECONDS[match[2]] if match else DEFAULT_INTERVAL_S


def interval_column(every: Column) -> Column:
    """The same rule for a column of schedule texts."""
    amount = F.regexp_extract(every, EVERY, 1)
    unit = F.regexp_extract(every, EVERY, 2)
    seconds = F.lit(None).cast("bigint")
    for name, size in UNIT_SECONDS.items():
        seconds = F.when(unit == name, F.lit(size)).otherwise(seconds)
    return F.coalesce(amount.try_cast("bigint") * seconds, F.lit(DEFAULT_INTERVAL_S))


def age_seconds(moment: Column, as_of: Column) -> Column:
    """Seconds between two times, fractions kept."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(moment.cast("timestamp"))) / F.lit(1_000_000.0)


def stale_column(last_success: Column, interval_s: Column, as_of: Column, factor: float = STALE_FACTOR) -> Column:
    """True when never loaded, or older than ``factor`` intervals (strictly)."""
    age = age_seconds(last_success, as_of)
    return last_success.isNull() | (age > interval_s * F.lit(factor))


def is_stale(last_success: datetime | None, interval_s: int, as_of: datetime, factor: float = STALE_FACTOR) -> bool:
    return last_success is None or as_of - last_success > timedelta(seconds=interval_s * factor)
