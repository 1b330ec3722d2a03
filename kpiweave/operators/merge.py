"""Row-level load semantics: append, upsert, dedupe, replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiweave.operators.quantiles import null_safe_join


def key_set(batch: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """The distinct keys of a batch: a hot key becomes one row before any join."""
    chosen = batch.select(*[F.col(f"`{k}`") for k in keys])
    return (chosen if null_safe else chosen.dropna("any")).distinct()


def kept_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Target rows whose key is not in the batch; a NULL in a key never matches."""
    arriving = key_set(batch, keys, null_safe)
    if null_safe:
        return null_safe_join(target, arriving, keys, "left_anti")
    return target.join(arriving, list(keys), "left_anti").select(*[F.col(f"`{c}`") for c in target.columns])


def upserted(target: DataFrame, batch: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Delete matching keys, then add the whole batch (its own duplicates all stay)."""
    return kept_rows(target, batch, keys, null_safe).unionByName(batch)


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """One row per key, the one with the greatest ``order_by`` (NULL is lowest).

    An aggregation, so that map-side combining shrinks a hot key before the shuffle.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    newest = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.max(F.struct(F.col(f"`{order_by}`").alias("rank"), whole.alias("whole"))).alias("top")
    )
    return newest.select("top.whole.*")


def replayed(runs: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """State after upserting runs one after another, from all their rows at once.

    A key keeps the rows of the last run it occurs in; rows with a NULL in the key are
    never replaced. ``ordinal`` numbers the runs and is dropped.
    """
    names = [c for c in runs.columns if c != ordinal]
    has_null = None
    for key in keys:
        missing = F.col(f"`{key}`").isNull()
        has_null = missing if has_null is None else has_null | missing
    last = (
        runs.filter(~has_null)
        .groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(F.max(ordinal).alias("__last"))
    )
    keyed = runs.filter(~has_null).join(last, list(keys)).filter(F.col(ordinal) == F.col("__last"))
    rest = runs.filter(has_null)
    columns = [F.col(f"`{c}`") for c in names]
    return keyed.select(*columns).unionByName(rest.select(*columns))
