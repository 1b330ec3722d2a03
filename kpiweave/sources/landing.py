"""The landing zone: each run's rows as one Parquet directory, written once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.functions.predicates import field_of
from kpiweave.operators.incremental import high_mark


@dataclass(frozen=True)
class Landed:
    path: str
    rows_read: int
    new_watermark: str | None
    schema: T.StructType


def land(df: DataFrame, path: str, watermark_column: str | None = None, previous: str | None = None) -> Landed:
    """Write the rows; count them and find the next mark in the same job.

    The mark stays where it was when the batch is empty or has no mark values.
    """
    measures = [F.count(F.lit(1)).alias("rows")]
    names = {n.lower() for n in df.columns}
    marked = watermark_column is not None and watermark_column.lower() in names
    if marked:
        measures.append(high_mark(df.schema, field_of(df.schema, watermark_column).name).alias("mark"))
    seen = Observation()
    df.observe(seen, *measures).write.parquet(path)
    found = seen.get
    return Landed(path, found["rows"], (found.get("mark") if marked else None) or previous, df.schema)
