"""CSV: dialect from a bounded sample, types from one pass, typed reading, bad rows."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.functions.predicates import field_of
from kpiweave.specs import SpecError

Paths = str | Sequence[str]

# Candidate delimiters, boolean words, shapes of typed text.
DELIMITERS = (",", ";", "\t", "|")
TRUE_WORDS = ("true", "t", "yes")
FALSE_WORDS = ("false", "f", "no")
INTEGER_SHAPE = r"^\s*(-\d+|0|[1-9]\d*)\s*$"
NUMBER_SHAPE = r"^\s*(-?(0|[1-9]\d*)(\.\d*)?([eE][+-]?\d+)?|-?\.\d+([eE][+-]?\d+)?|nan)\s*$"
DATE_SHAPE = r"^\d{1,4}-\d{1,2}-\d{1,4}$"
STAMP_SHAPE = r"^(\d{1,4}-\d{1,2}-\d{1,4})[ T](\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?)(Z|[+-]\d{2}:?\d{2})?$"
TIME_SHAPE = r"^\d{1,2}:\d{2}:\d{2}(\.\d{1,6})?$"
DATE_ORDERS = ("yyyy-M-d", "d-M-yyyy", "M-d-yyyy")
ORDER_SHAPES = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$")
MAX_BIGINT_DIGITS = 18
BAD_RECORD = "_bad_record"
SAMPLE_LINES = 200


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    has_header: bool = True
    names: tuple[str, ...] = ()
    multi_line: bool = False
    own_names: bool = False  # the header's names are the columns' names as they are


@dataclass(frozen=True)
class InferredColumn:
    name: str
    type: str
    nullable: bool = True
    include: bool = True
    nulls: int | None = None
    # How date text is ordered, where the type is a date or a timestamp.
    date_order: str | None = None


@dataclass(frozen=True)
class InferredSchema:
    columns: tuple[InferredColumn, ...]
    delimiter: str | None = None
    has_header: bool | None = None
    row_estimate: int | None = None
    sample_rows: tuple[dict[str, Any], ...] = ()
    warnings: tuple[str, ...] = ()
    dialect: Dialect = field(default_factory=Dialect)


def as_list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def suggested_table(file_name: str) -> str:
    """A table name made from a file name."""
    stem = PurePosixPath(file_name.replace("\\", "/")).name.rsplit(".", 1)[0]
    cleaned = re.sub(r"[^A-Za-z0-9_]+", "_", stem).strip("_").lower()
    if not cleaned:
        return "dataset"
    return cleaned[:128] if cleaned[0].isalpha() else f"t_{cleaned}"[:128]


# --- dialect ------------------------------------------------------------------


def sniff(spark: SparkSession, paths: Paths, delimiter: str | None = None) -> Dialect:
    """Delimiter and header of a set of files with one format, from the first lines."""
    found = spark.read.text(as_list(paths)).select("_metadata.file_path").first()
    if found is None:
        return Dialect(delimiter or ",")
    lines = [r.value for r in spark.read.text(found[0]).limit(SAMPLE_LINES).collect()]
    candidates = [delimiter] if delimiter else DELIMITERS
    split = {d: list(csv.reader(lines, delimiter=d)) for d in candidates}
    best = max(candidates, key=lambda d: _consistency(split[d]))
    rows = [row for row in split[best] if row]
    has_header, names = _header(rows)
    # A field with a line break leaves a line with an open quote. Any such line counts, so all are read.
    value = F.col("value")
    open_quote = (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 1
    multi_line = not spark.read.text(as_list(paths)).where(open_quote).isEmpty()
    return Dialect(best, has_header, names, multi_line, has_header and list(names) == rows[0])


def _consistency(rows: list[list[str]]) -> tuple[float, int]:
    widths = [len(r) for r in rows if r]
    usual = max(set(widths), key=widths.count)
    if usual == 1:
        return (0.0, 1)
    return (widths.count(usual) / len(widths), usual)


def _looks_typed(text: str) -> bool:
    dashed = text.strip().translate(str.maketrans("/.", "--"))
    shapes = ((INTEGER_SHAPE, text), (NUMBER_SHAPE, text), (DATE_SHAPE, dashed), (STAMP_SHAPE, dashed), (TIME_SHAPE, text))
    word = text.strip().lower() in TRUE_WORDS + FALSE_WORDS
    return word or any(re.match(shape, value) for shape, value in shapes)


def _header(rows: list[list[str]]) -> tuple[bool, tuple[str, ...]]:
    """A first line is a header unless it fits the types of the lines below it."""
    first, body = rows[0], rows[1:]
    typed = []
    for i in range(len(first)):
        values = [r[i] for r in body if i < len(r) and r[i] != ""]
        typed.append(bool(values) and all(map(_looks_typed, values)))
    if not body:
        header = not any(_looks_typed(v) for v in first)
    elif any(typed):
        header = any(t and v != "" and not _looks_typed(v) for t, v in zip(typed, first, strict=True))
    else:
        header = True
    if not header:
        return False, tuple(f"column{i}" for i in range(len(first)))
    names: list[str] = []
    for i, raw in enumerate(first):
        base = raw or f"column{i}"
        name, again = base, 0
        while name.lower() in {n.lower() for n in names}:
            again += 1
            name = f"{base}_{again}"
        names.append(name)
    return True, tuple(names)


# --- text and types -------------------------------------------------------------


def read_text_columns(
    spark: SparkSession,
    paths: Paths,
    dialect: Dialect,
    keep_bad: bool = False,
    with_file: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Every column as text, empty fields as NULL; ``keep_bad`` adds the raw bad lines.

    ``strict``: a line with more or fewer fields is an error instead of being cut or filled up.
    """
    fields = [T.StructField(n, T.StringType()) for n in dialect.names]
    reader = (
        spark.read.option("sep", dialect.delimiter)
        .option("header", dialect.has_header)
        # Files whose headers name other columns, or these in another order, are refused.
        .option("enforceSchema", not dialect.own_names)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("multiLine", dialect.multi_line)
        .option("mode", "PERMISSIVE")
    )
    if keep_bad:
        fields.append(T.StructField(BAD_RECORD, T.StringType()))
        # A line's field count is only checked when no column is pruned away.
        reader = reader.option("columnNameOfCorruptRecord", BAD_RECORD).option("columnPruning", False)
    elif strict:
        reader = reader.option("mode", "FAILFAST").option("columnPruning", False)
    frame = reader.schema(T.StructType(fields)).csv(as_list(paths))
    columns = [F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) for n in dialect.names]
    if keep_bad:
        columns.append(F.col(BAD_RECORD))
    if with_file:
        columns.append(F.col("_metadata.file_name").alias("_file"))
    return frame.select(*columns)


def _dashed(text: Column) -> Column:
    """Date separators as dashes; the fraction dot of a time stays."""
    trimmed = F.trim(text)
    day = F.regexp_extract(trimmed, r"^([0-9./-]+)", 1)
    return F.concat(F.translate(day, "/.", "--"), F.substr(trimmed, F.length(day) + 1))


def _parsed_day(dashed: Column, order: str) -> Column:
    """The leading date of a dashed text; only texts of the order's shape are parsed."""
    day = F.substring_index(F.substring_index(dashed, " ", 1), "T", 1)
    shaped = F.when(day.rlike(ORDER_SHAPES[DATE_ORDERS.index(order)]), day)
    return F.to_date(F.try_to_timestamp(shaped, F.lit(order)))


def _tests(text: Column, dashed: Column) -> dict[str, Column]:
    """Named row tests; a column has a type when all its non-NULL texts pass."""
    lowered = F.lower(F.trim(text))
    whole = text.rlike(INTEGER_SHAPE)
    stamped = dashed.rlike(STAMP_SHAPE)
    dated = dashed.rlike(DATE_SHAPE)
    tests = {
        "boolean": lowered.isin(*TRUE_WORDS, *FALSE_WORDS),
        "bigint": whole & (F.length(F.trim(text)) <= MAX_BIGINT_DIGITS),
        "hugeint": whole & (F.length(F.trim(text)) <= 38),
        "double": lowered.rlike(NUMBER_SHAPE),
        "date": dated,
        "stamp": stamped | dated,
        "zoned": stamped & dashed.rlike(r"(Z|[+-]\d{2}:?\d{2})$"),
    }
    for i, order in enumerate(DATE_ORDERS):
        tests[f"order{i}"] = _parsed_day(dashed, order).isNotNull()
    return tests


def _type_of(counts: Mapping[str, int], n: int) -> tuple[str, str | None]:
    if n == 0:
        return "string", None
    full = {name for name, count in counts.items() if count == n}
    for test, kind in (("boolean", "boolean"), ("bigint", "bigint"), ("hugeint", "decimal(38,0)"), ("double", "double")):
        if test in full:
            return kind, None
    order = next((o for i, o in enumerate(DATE_ORDERS) if f"order{i}" in full), None)
    if order and "date" in full:
        return "date", order
    if order and "zoned" in full:
        return "timestamp", order
    if order and "stamp" in full and counts["zoned"] == 0:
        return "timestamp_ntz", order
    return "string", None


def column_profile(texts: DataFrame, names: Sequence[str]) -> tuple[int, dict[str, tuple[int, str, str | None]]]:
    """One aggregation over all rows: the row count and, per column, NULLs and type."""
    measures = [F.count(F.lit(1)).alias("rows")]
    tests: list[str] = []
    # Numbered columns, with the dashed form made once per text.
    numbered = [F.col(f"`{name}`").alias(f"t{i}") for i, name in enumerate(names)]
    texts = texts.select(*numbered).select("*", *[_dashed(F.col(f"t{i}")).alias(f"d{i}") for i in range(len(names))])
    for i in range(len(names)):
        text = F.col(f"t{i}")
        checks = _tests(text, F.col(f"d{i}"))
        tests = list(checks)
        measures.append(F.count(text).alias(f"n{i}"))
        measures += [F.count_if(check).alias(f"{label}{i}") for label, check in checks.items()]
    row = texts.agg(*measures).first()
    found = {}
    for i, name in enumerate(names):
        n = row[f"n{i}"]
        kind, order = _type_of({label: row[f"{label}{i}"] for label in tests}, n)
        found[name] = (row["rows"] - n, kind, order)
    return row["rows"], found


def typed(text: Column, kind: str, order: str | None = None) -> Column:
    """The text as ``kind``; a text that does not fit becomes NULL."""
    if kind == "string":
        return text
    if kind == "boolean":
        word = F.lower(F.trim(text))
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    if kind == "date":
        return _parsed_day(_dashed(text), order or DATE_ORDERS[0])
    if kind in ("timestamp", "timestamp_ntz"):
        day = _parsed_day(_dashed(text), order or DATE_ORDERS[0]).cast("string")
        clock = F.regexp_extract(_dashed(text), r"[ T](.*)$", 1)
        return F.concat(day, F.lit(" "), clock).try_cast(kind)
    return text.try_cast(kind)


# --- public readers ----------------------------------------------------------------


def infer_csv(spark: SparkSession, paths: Paths, sample_rows: int = 20, delimiter: str | None = None) -> InferredSchema:
    """Dialect, column names and types, exact row count and a sample, for review."""
    dialect = sniff(spark, paths, delimiter)
    if not dialect.names:
        return InferredSchema((), dialect.delimiter, dialect.has_header, 0, (), ("no columns detected",), dialect)
    texts = read_text_columns(spark, paths, dialect)
    rows, found = column_profile(texts, dialect.names)
    columns = tuple(
        InferredColumn(name, found[name][1], True, True, found[name][0], found[name][2]) for name in dialect.names
    )
    warnings = ["a quoted field spans lines; the file is read without splitting"] if dialect.multi_line else []
    warnings += [f"column {c.name} is empty" for c in columns if rows and c.nulls == rows]
    schema = InferredSchema(columns, dialect.delimiter, dialect.has_header, rows, (), tuple(warnings), dialect)
    preview = apply_types(texts, schema).limit(sample_rows)
    sample = tuple(json_row(r.asDict()) for r in preview.collect())
    return InferredSchema(columns, dialect.delimiter, dialect.has_header, rows, sample, tuple(warnings), dialect)


def json_row(row: Mapping[str, Any]) -> dict[str, Any]:
    """A preview row with values that JSON can carry."""

    def plain(value: Any) -> Any:
        if hasattr(value, "isoformat"):
            return value.isoformat()
        return float(value) if type(value).__name__ == "Decimal" else value

    return {key: plain(value) for key, value in row.items()}


def apply_types(
    texts: DataFrame, schema: InferredSchema, types: Mapping[str, str] | None = None, strict: bool = False
) -> DataFrame:
    """Included columns of the text frame, cast to their inferred or corrected types."""
    overrides = dict(types or {})
    columns = []
    for c in schema.columns:
        if c.include:
            kind = overrides.pop(c.name, c.type)
            text = F.col(f"`{c.name}`")
            value = typed(text, kind, c.date_order)
            if strict and kind != c.type:
                told = F.concat(F.lit(f"{c.name} is not {kind}: "), text)
                value = F.when(text.isNotNull() & value.isNull(), F.raise_error(told)).otherwise(value)
            columns.append(value.alias(c.name))
    if overrides:
        raise SpecError(f"type given for unknown columns: {', '.join(overrides)}")
    extra = [F.col(c) for c in texts.columns if c in (BAD_RECORD, "_file")]
    return texts.select(*columns, *extra)


def read_csv(
    spark: SparkSession,
    paths: Paths,
    columns: Sequence[str] = (),
    types: Mapping[str, str] | None = None,
    schema: InferredSchema | None = None,
    with_file: bool = False,
) -> DataFrame:
    """Typed rows of one or many CSV files (list or glob) with one format.

    Lines with another number of fields, files with other headers, and texts that do not fit a
    corrected type are errors; ``checked_rows`` sets such rows aside instead.
    """
    known = schema or infer_csv(spark, paths, sample_rows=0)
    texts = read_text_columns(spark, paths, known.dialect, with_file=with_file, strict=True)
    frame = apply_types(texts, known, types, strict=True)
    if columns:
        wanted = [field_of(frame.schema, c).name for c in columns]
        frame = frame.select(*[F.col(f"`{c}`") for c in wanted], *(["_file"] if with_file else []))
    return frame


def checked_rows(
    spark: SparkSession, paths: Paths, types: Mapping[str, str] | None = None, schema: InferredSchema | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows): the bad ones as ``file, record, reason``.

    A row is bad when its field count is wrong or a text does not fit the column's
    corrected type.
    """
    known = schema or infer_csv(spark, paths, sample_rows=0)
    texts = read_text_columns(spark, paths, known.dialect, keep_bad=True, with_file=True)
    corrected = dict(types or {})
    reason = F.when(F.col(BAD_RECORD).isNotNull(), F.lit("wrong number of fields"))
    for c in known.columns:
        kind = corrected.get(c.name, c.type)
        text = F.col(f"`{c.name}`")
        misfit = text.isNotNull() & typed(text, kind, c.date_order).isNull()
        reason = reason.when(misfit, F.lit(f"{c.name} is not {kind}"))
    judged = texts.withColumn("reason", reason)
    good = apply_types(judged.filter(F.col("reason").isNull()), known, types).drop(BAD_RECORD, "_file")
    record = F.coalesce(
        F.col(BAD_RECORD),
        F.concat_ws(known.dialect.delimiter, *[F.coalesce(F.col(f"`{c.name}`"), F.lit("")) for c in known.columns]),
    )
    bad = judged.filter(F.col("reason").isNotNull()).select(F.col("_file").alias("file"), record.alias("record"), "reason")
    return good, bad


def rejects_by_reason(bad: DataFrame) -> DataFrame:
    return bad.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("rows"))
