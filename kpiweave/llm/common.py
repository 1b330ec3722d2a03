"""What several operators share: tables, text columns, held-out folds, shared folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiweave.session import shared_folder

#: Text bytes that one Arrow batch to a Python worker may hold.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the Arrow batches of the session's later jobs by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, read by Spark alone; Arrow batches of the session are bounded."""
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(text: Column | str = "text") -> Column:
    """The text, null as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered and nothing else; the quick path holds where all characters are ASCII."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def scratch(spark: SparkSession, label: str) -> str:
    """An unused path in the folder that all executors share."""
    return f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    texts = texts.cast(pa.large_binary()) if pa.types.is_string(texts.type) else texts
    ends = np.cumsum(np.maximum(1, pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


def lists_of(parts: Iterable[bytes], kind: str = "<i4") -> pa.ListArray:
    """One Arrow list of integers for each run of packed integers."""
    parts = list(parts)
    width = np.dtype(kind).itemsize
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // width for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), kind)))
