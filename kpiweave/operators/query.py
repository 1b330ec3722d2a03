"""A structured query as a DataFrame plan: filter, group, aggregate, sort, page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.functions.aggregates import aggregate, is_clock
from kpiweave.functions.predicates import column_of, field_of, where
from kpiweave.operators.quantiles import exact_median, null_safe_join
from kpiweave.specs import Aggregation, Filter, QuerySpec, Sort, SpecError


def order_columns(sort: Sequence[Sort], schema: T.StructType) -> list[Column]:
    """Sort keys; NULLs come last in both directions."""
    keys = []
    for key in sort:
        column = column_of(schema, key.col)
        keys.append(column.desc_nulls_last() if key.dir == "desc" else column.asc_nulls_last())
    return keys


def _by_rank(df: DataFrame, agg: Aggregation) -> bool:
    """Whether the aggregate is a median that is selected by rank; texts are refused and booleans counted elsewhere."""
    kind = field_of(df.schema, agg.col).dataType if agg.fn == "median" else None
    return isinstance(kind, T.NumericType) or kind is not None and is_clock(kind)


def grouped(df: DataFrame, group_by: Sequence[str], aggregations: Sequence[Aggregation]) -> DataFrame:
    """Group columns first, then the aggregates, in the order given."""
    keys = [field_of(df.schema, name).name for name in group_by]
    medians = [a for a in aggregations if _by_rank(df, a)]
    plain = [aggregate(df.schema, a) for a in aggregations if a not in medians]
    columns = [F.col(f"`{k}`") for k in keys]
    if not medians:
        return df.groupBy(*columns).agg(*plain)
    # Medians hang on a table that has every group, also those without a value; a global one has one row always.
    groups = [f"__g{i}" for i in range(len(keys))] or ["__g0"]
    if keys:
        base = df.select(*[c.alias(g) for c, g in zip(columns, groups, strict=True)], "*")
        result = base.groupBy(*groups).agg(*plain) if plain else base.select(*groups).distinct()
    else:
        result = df.agg(F.lit(1).alias("__g0"), *plain)
    for a in medians:
        result = null_safe_join(result, exact_median(df, keys, a.col, a.alias), groups, "left")
    named = [F.col(g).alias(k) for g, k in zip(groups, keys, strict=False)]
    return result.select(*named, *[F.col(f"`{a.alias}`") for a in aggregations])


def unpaged(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """The query without sort and page: filters, then projection or aggregation."""
    kept = where(df, spec.filters)
    if spec.aggregations:
        return grouped(kept, spec.group_by, spec.aggregations)
    if spec.columns:
        return kept.select(*[column_of(df.schema, c) for c in spec.columns])
    return kept


def apply_query(df: DataFrame, spec: QuerySpec, tie_break: Sequence[str] = ()) -> DataFrame:
    """Run ``spec`` over ``df``.

    Without aggregations ``group_by`` has no effect, and a projection may sort by a
    column it does not return. ``tie_break`` appends ascending sort keys so that pages
    are stable.
    """
    sort = [*spec.sort, *(Sort(c) for c in tie_break)]
    if spec.aggregations:
        rows = unpaged(df, spec)
        return _paged(rows, order_columns(sort, rows.schema), spec)
    kept = where(df, spec.filters)
    rows = _paged(kept, order_columns(sort, df.schema), spec)
    return rows.select(*[column_of(df.schema, c) for c in spec.columns]) if spec.columns else rows


def _paged(rows: DataFrame, order: list[Column], spec: QuerySpec) -> DataFrame:
    if order:
        rows = rows.orderBy(*order)
    if spec.offset:
        rows = rows.offset(spec.offset)
    return rows.limit(spec.limit)


def count_total(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """One row ``n``: how many rows pass the filters, before any page."""
    return where(df, filters).agg(F.count(F.lit(1)).alias("n"))


# --- query text -------------------------------------------------------------

_CALLS = {"count_distinct": "count(DISTINCT {})"}


def _name(identifier: str, quote: str) -> str:
    return f"{quote}{identifier}{quote}"


def _condition(spec: Filter, quote: str) -> tuple[str, list]:
    column = _name(spec.col, quote)
    if spec.op.startswith("is_"):
        return f"{column} {spec.op.replace('_', ' ').upper()}", []
    if spec.op in ("in", "not_in"):
        members = list(spec.value or ())
        if not members:
            return ("FALSE" if spec.op == "in" else "TRUE"), []
        negation = "NOT " if spec.op == "not_in" else ""
        return f"{column} {negation}IN ({', '.join('?' * len(members))})", members
    if spec.op == "between":
        return f"{column} BETWEEN ? AND ?", list(spec.value)
    return f"{column} {spec.op.upper()} ?", [spec.value]


def _call(agg: Aggregation, quote: str) -> str:
    argument = _name(agg.col, quote) if agg.col else "*"
    return f"{_CALLS.get(agg.fn, agg.fn + '({})').format(argument)} AS {_name(agg.alias, quote)}"


def query_text(spec: QuerySpec, quote: str = '"') -> tuple[str, list]:
    """The query as SQL text with ``?`` markers, and the values bound to them.

    For display next to a result; execution always goes through ``apply_query``.
    """
    if spec.aggregations:
        outputs = [_name(c, quote) for c in spec.group_by] + [_call(a, quote) for a in spec.aggregations]
    else:
        outputs = [_name(c, quote) for c in spec.columns] or ["*"]
    pieces = [f"SELECT {', '.join(outputs)}", f"FROM {_name(spec.table, quote)}"]
    values: list = []
    if spec.filters:
        conditions = []
        for item in spec.filters:
            text, bound = _condition(item, quote)
            conditions.append(text)
            values += bound
        pieces.append(f"WHERE {' AND '.join(conditions)}")
    if spec.aggregations and spec.group_by:
        pieces.append(f"GROUP BY {', '.join(_name(c, quote) for c in spec.group_by)}")
    if spec.sort:
        keys = [f"{_name(s.col, quote)} {s.dir.upper()} NULLS LAST" for s in spec.sort]
        pieces.append(f"ORDER BY {', '.join(keys)}")
    pieces.append("LIMIT ? OFFSET ?")
    return " ".join(pieces), [*values, spec.limit, spec.offset]


def explain_shape(spec: QuerySpec, df: DataFrame) -> T.StructType:
    """Output schema of the query; raises SpecError where it cannot be planned."""
    try:
        return apply_query(df, spec).schema
    except SpecError:
        raise
    except Exception as error:
        raise SpecError(str(error)) from error
