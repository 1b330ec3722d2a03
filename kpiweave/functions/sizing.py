"""Size checks that guard single-task or broadcast strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate after column pruning; unknown inputs count as huge."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
