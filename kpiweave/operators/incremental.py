"""High-water-mark extraction: rows after a mark, an exact cap, the next mark."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.functions.aggregates import is_clock
from kpiweave.functions.predicates import column_of, field_of, literal
from kpiweave.operators.quantiles import value_at_rank
from kpiweave.specs import SpecError


def mark_literal(schema: T.StructType, column: str, mark: str) -> Column:
    """The stored text of a mark as the column's type ("9" is below "10")."""
    kind = field_of(schema, column).dataType
    return literal(mark, kind).cast(kind)


def since(df: DataFrame, column: str, mark: str | None, lag: str | None = None) -> DataFrame:
    """Rows strictly after the mark; ``lag`` ("2 hours") reads some again for late rows.

    A lag needs an upsert target, which replaces the rows read twice.
    """
    if mark is None:
        return df
    bound = mark_literal(df.schema, column, mark)
    if lag:
        bound = bound - F.expr(f"INTERVAL {lag}")
    return df.filter(column_of(df.schema, column) > bound)


def capped(df: DataFrame, column: str | None, cap: int | None, first: bool = True) -> DataFrame:
    """The oldest rows up to ``cap``, never cutting through rows with the same mark.

    The value at the cap is found by distributed rank selection; the extract is then a
    plain filter, so nothing is funnelled through one task, and the next run starts
    exactly after it. Rows without a mark come, all of them, with the ``first`` extract.
    Without a mark column a cap would lose rows for good, so it is refused.
    """
    if cap is None:
        return df
    if column is None:
        raise SpecError("a row cap needs a watermark column among the columns read")
    cut = value_at_rank(df, column, cap + 1)
    if cut is None:
        return df
    mark = column_of(df.schema, column)
    kind = field_of(df.schema, column).dataType
    unmarked = mark.isNull() if first else F.lit(False)
    older = df.filter((mark < literal(cut, kind)) | unmarked)
    if older.filter(mark.isNotNull()).select(mark).isEmpty():
        # More rows share the oldest mark than the cap allows: take them all.
        return df.filter((mark <= literal(cut, kind)) | unmarked)
    return older


def later_mark(kind: T.DataType, old: str | None, new: str | None) -> str | None:
    """The greater of two stored marks of a column of type ``kind``; a mark never goes back."""
    if old is None or new is None:
        return new if old is None else old
    if isinstance(kind, T.NumericType):
        return max(old, new, key=Decimal)
    if is_clock(kind):
        return max(old, new, key=lambda text: datetime.fromisoformat(text).replace(tzinfo=None))
    return max(old, new)


def high_mark(df_schema: T.StructType, column: str) -> Column:
    """Aggregate: the greatest mark as text, NULLs ignored."""
    kind = field_of(df_schema, column).dataType
    top = F.max(column_of(df_schema, column)).cast("string")
    return F.replace(top, F.lit(" "), F.lit("T")) if is_clock(kind) else top
