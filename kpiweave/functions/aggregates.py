"""The aggregate functions of a query, as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.functions.predicates import column_of, field_of
from kpiweave.specs import Aggregation, SpecError

LIMB_BITS = 22
_NUMERIC = (T.NumericType,)
_CLOCK = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_clock(kind: T.DataType) -> bool:
    return isinstance(kind, _CLOCK)


def clock_micros(column: Column, kind: T.DataType) -> Column:
    """Microseconds since the epoch; wall-clock times go through the session zone."""
    stamp = column if isinstance(kind, T.TimestampType) else column.cast("timestamp")
    return F.unix_micros(stamp)


def micros_clock(micros: Column, kind: T.DataType) -> Column:
    stamp = F.timestamp_micros(micros.cast("bigint"))
    return stamp if isinstance(kind, T.TimestampType) else stamp.cast("timestamp_ntz")


def _reject(spec: Aggregation, kind: T.DataType) -> SpecError:
    return SpecError(f"{spec.fn} does not take {kind.simpleString()} ({spec.col})")


def aggregate(schema: T.StructType, spec: Aggregation) -> Column:
    """One aggregation, aliased; NULLs are skipped, an empty group gives NULL."""
    if spec.col is None:
        return F.count(F.lit(1)).alias(spec.alias)
    column = column_of(schema, spec.col)
    kind = field_of(schema, spec.col).dataType
    build = {
        "count": lambda: F.count(column),
        "count_distinct": lambda: F.count_distinct(column),
        "min": lambda: F.min(column),
        "max": lambda: F.max(column),
        "sum": lambda: _sum(spec, column, kind),
        "avg": lambda: _avg(spec, column, kind),
        "stddev": lambda: _stddev(spec, column, kind),
        "median": lambda: _median(spec, column, kind),
    }
    return build[spec.fn]().alias(spec.alias)


def _sum(spec: Aggregation, column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return F.sum(column.cast("int"))
    if isinstance(kind, T.LongType):
        return _wide_sum(column)
    if isinstance(kind, T.FloatType):
        return F.sum(column.cast("double"))
    if isinstance(kind, _NUMERIC):
        return F.sum(column)
    raise _reject(spec, kind)


def _wide_sum(column: Column) -> Column:
    """Exact sum of 64-bit integers, which may pass 64 bits, as a decimal.

    Three limbs are summed as plain integers inside generated code (good for 2^41 rows
    per group, and an error past that) and put together once per group.
    """
    mask = F.lit((1 << LIMB_BITS) - 1)
    limbs = (
        column.bitwiseAND(mask),
        F.shiftright(column, LIMB_BITS).bitwiseAND(mask),
        F.shiftright(column, 2 * LIMB_BITS),
    )
    low, middle, high = (F.sum(limb).cast("decimal(19,0)") for limb in limbs)
    step = F.lit(Decimal(1 << LIMB_BITS))
    return ((high * step).cast("decimal(30,0)") * step + middle * step + low).cast("decimal(38,0)")


def _avg(spec: Aggregation, column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, _NUMERIC):
        return F.avg(column.cast("double"))
    if is_clock(kind):
        # Nearest microsecond, halves towards the epoch; a decimal sum keeps every digit.
        micros = clock_micros(column, kind)
        total, n = F.sum(micros.cast("decimal(20,0)")), F.count(micros)
        rest = total % n
        step = F.when(2 * F.abs(rest) > n, F.signum(rest).cast("int")).otherwise(0)
        return micros_clock((total - rest) / n + step, kind)
    raise _reject(spec, kind)


def _stddev(spec: Aggregation, column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, _NUMERIC):
        return F.stddev_samp(column.cast("double"))
    raise _reject(spec, kind)


def _median(spec: Aggregation, column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        # The lower of the two middle values: true only when trues are the majority.
        return F.when(F.count(column) > 0, 2 * F.count_if(column) > F.count(column))
    if isinstance(kind, T.FloatType):
        return F.median(column).cast("float")
    if is_clock(kind):
        return micros_clock(F.round(F.median(clock_micros(column, kind))), kind)
    if isinstance(kind, _NUMERIC) and not isinstance(kind, T.DecimalType):
        return F.median(column)
    raise _reject(spec, kind)
