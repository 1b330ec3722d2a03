"""Typed filter predicates as columns, so that Catalyst pushes them to the scan."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import UTC, date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.specs import Filter, SpecError, check_name


def field_of(schema: T.StructType, name: str) -> T.StructField:
    """The field called ``name``; names resolve without regard to case."""
    check_name(name)
    hits = [f for f in schema.fields if f.name == name] or [
        f for f in schema.fields if f.name.lower() == name.lower()
    ]
    if len(hits) != 1:
        problem = "ambiguous" if hits else "unknown"
        raise SpecError(f"{problem} column {name!r}; have {', '.join(schema.fieldNames())}")
    return hits[0]


def column_of(schema: T.StructType, name: str) -> Column:
    return F.col(f"`{field_of(schema, name).name}`")


def literal(value: Any, kind: T.DataType) -> Column:
    """``value`` as a literal that compares with a column of type ``kind``.

    Text is cast to the column's type (an uncastable text is an error). A fractional
    number against an integer column stays fractional, so that 2.5 is not cut to 2.
    """
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit(_as_text(value))
    if isinstance(kind, T.DecimalType) and not isinstance(value, (bool, datetime, date)):
        return _decimal(value, kind)
    if isinstance(value, bool):
        return F.lit(value) if isinstance(kind, T.BooleanType) else F.lit(int(value)).cast(kind)
    if isinstance(value, (float, Decimal)) and isinstance(kind, T.IntegralType):
        return F.lit(value)
    if isinstance(value, int) and isinstance(kind, T.IntegralType):
        return F.lit(value)
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(UTC).replace(tzinfo=None)
        stamp = T.TimestampNTZType() if isinstance(kind, T.TimestampNTZType) else T.TimestampType()
        return F.lit(value.isoformat(sep=" ")).cast(stamp)
    if isinstance(value, str) and isinstance(kind, T.NumericType):
        return _number(value, kind)
    return F.lit(value).cast(kind)


def _decimal(value: Any, kind: T.DecimalType) -> Column:
    """A number for a decimal column: as the column's type where that holds it, else at its own scale."""
    try:
        number = Decimal(str(value).strip())
    except ArithmeticError as error:
        raise SpecError(f"{value!r} is not a number") from error
    if not number.is_finite():
        return F.lit(float(number))
    _, digits, exponent = number.normalize().as_tuple()
    scale = max(0, -exponent)
    whole = max(0, len(digits) + exponent)
    if scale <= kind.scale and whole <= kind.precision - kind.scale:
        return F.lit(str(number)).cast(kind)
    if whole + scale > 38:
        return F.lit(float(number))
    return F.lit(format(number, "f")).cast(T.DecimalType(max(1, whole + scale), scale))


def _number(text: str, kind: T.DataType) -> Column:
    try:
        number = Decimal(text.strip())
    except ArithmeticError as error:
        raise SpecError(f"{text!r} is not a number") from error
    if isinstance(kind, T.IntegralType):
        if number != number.to_integral_value():
            raise SpecError(f"{text!r} is not a whole number")
        return F.lit(int(number))
    return F.lit(text.strip()).cast(kind)


def _as_text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, date):
        return value.isoformat()
    return str(value)


def predicate(schema: T.StructType, spec: Filter) -> Column:
    """One filter as a boolean column with SQL's three-valued logic."""
    column = column_of(schema, spec.col)
    kind = field_of(schema, spec.col).dataType

    def bound(value: Any) -> Column:
        return literal(value, kind)

    match spec.op:
        case "is_null":
            return column.isNull()
        case "is_not_null":
            return column.isNotNull()
        case "in" | "not_in":
            members = [bound(v) for v in spec.value or ()]
            if not members:
                return F.lit(spec.op == "not_in")
            inside = column.isin(*members)
            return inside if spec.op == "in" else ~inside
        case "between":
            low, high = spec.value
            return column.between(bound(low), bound(high))
        case "like":
            if not isinstance(kind, T.StringType):
                raise SpecError(f"like needs a text column; {spec.col} is {kind.simpleString()}")
            if spec.value is None:
                return F.lit(None).cast("boolean")
            # The pattern language has no escape character; Spark's has one.
            return column.like(str(spec.value).replace("\\", "\\\\"))
        case "=":
            return column == bound(spec.value)
        case "!=":
            return column != bound(spec.value)
        case ">":
            return column > bound(spec.value)
        case ">=":
            return column >= bound(spec.value)
        case "<":
            return column < bound(spec.value)
        case "<=":
            return column <= bound(spec.value)
    raise SpecError(f"unknown filter op {spec.op!r}")


def where(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    """Rows of ``df`` for which every filter is true."""
    terms = [predicate(df.schema, f) for f in filters]
    return df.filter(reduce(lambda a, b: a & b, terms)) if terms else df
