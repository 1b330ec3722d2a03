"""Aligning a batch to a table by name, and describing how schemas differ."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lossless widenings accepted without calling them drift.
_WIDER = {
    "tinyint": ("smallint", "int", "bigint", "double"),
    "smallint": ("int", "bigint", "double"),
    "int": ("bigint", "double"),
    "float": ("double",),
    "date": ("timestamp", "timestamp_ntz"),
}


def widens(new: T.DataType, old: T.DataType) -> bool:
    """Whether every value of type ``new`` is exactly one of type ``old``."""
    if new == old or isinstance(new, T.NullType) or old.simpleString() in _WIDER.get(new.simpleString(), ()):
        return True
    if not isinstance(old, T.DecimalType):
        return False
    digits = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}.get(new.simpleString())
    if digits:
        return old.precision - old.scale >= digits
    return isinstance(new, T.DecimalType) and old.scale >= new.scale and old.precision - old.scale >= new.precision - new.scale


class SchemaDrift(ValueError):
    """A batch does not fit the table it is loaded into."""

    def __init__(self, drift: Drift) -> None:
        super().__init__(drift.summary())
        self.drift = drift


@dataclass(frozen=True)
class Drift:
    """What a batch has more, less or different; order alone is harmless."""

    added: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()
    retyped: tuple[tuple[str, str, str], ...] = ()
    reordered: bool = False

    @property
    def blocking(self) -> bool:
        return bool(self.added or self.removed or self.retyped)

    def summary(self) -> str:
        bits = []
        if self.added:
            bits.append(f"added {', '.join(self.added)}")
        if self.removed:
            bits.append(f"missing {', '.join(self.removed)}")
        bits += [f"{name} is {new}, table has {old}" for name, old, new in self.retyped]
        if self.reordered:
            bits.append("columns reordered")
        return "; ".join(bits) or "no drift"


def field_name(schema: T.StructType, name: str) -> str:
    """The schema's own spelling of a name."""
    return next(n for n in schema.names if n.lower() == name.lower())


def compare(expected: T.StructType, actual: T.StructType) -> Drift:
    want = {f.name.lower(): f for f in expected.fields}
    have = {f.name.lower(): f for f in actual.fields}
    retyped = []
    for name in want.keys() & have.keys():
        old, new = want[name].dataType.simpleString(), have[name].dataType.simpleString()
        if not widens(have[name].dataType, want[name].dataType):
            retyped.append((want[name].name, old, new))
    common_want = [n for n in want if n in have]
    common_have = [n for n in have if n in want]
    return Drift(
        added=tuple(f.name for n, f in have.items() if n not in want),
        removed=tuple(f.name for n, f in want.items() if n not in have),
        retyped=tuple(sorted(retyped)),
        reordered=common_want != common_have,
    )


def aligned(batch: DataFrame, expected: T.StructType) -> DataFrame:
    """The batch in the table's column order and types; raises SchemaDrift if it cannot.

    Where only types differ, the values decide: a column without any value fits each type, and
    one fits whose values all come back unchanged from the table's type. They are counted in one
    pass, which loads of plainly fitting batches do not need.
    """
    drift = compare(expected, batch.schema)
    if drift.retyped and not (drift.added or drift.removed):
        kinds = {f.name: f.dataType for f in expected.fields}
        lost = []
        for name, _, _ in drift.retyped:
            value, kind = F.col(f"`{name}`"), batch.schema[field_name(batch.schema, name)].dataType
            back = value.try_cast(kinds[name])
            # Text is compared with nothing: only a column without values fits another type.
            same = F.lit(False) if isinstance(kind, T.StringType) else back.try_cast(kind).eqNullSafe(value)
            lost.append(F.count_if(value.isNotNull() & ~same))
        if not any(batch.agg(*[c.alias(f"n{i}") for i, c in enumerate(lost)]).first()):
            drift = Drift(reordered=drift.reordered)
    if drift.blocking:
        raise SchemaDrift(drift)
    return batch.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in expected.fields])
