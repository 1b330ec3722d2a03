"""Exact order statistics, bounded when one group holds most rows; one plan for inputs of any size.

A median takes three steps:

1. a quantile sketch per group (map-side combined) gives a value range that is guaranteed to hold
   the middle ranks;
2. one aggregation counts the rows below the range and the values inside it;
3. the range is cut into equal slices; counting them finds the one or two that hold the middle
   ranks, and a window over those picks the exact values.

A single rank is found by the bits of 64-bit keys of the same order (doubles by exponent and
mantissa, NaN last): each round counts rows by the next 16 bits below the bits found so far.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.functions.aggregates import clock_micros, is_clock, micros_clock
from kpiweave.functions.predicates import column_of, field_of
from kpiweave.specs import SpecError

SKETCH_ACCURACY = 20_000
SLICES = 1024


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the left keys are kept."""
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, same, how).drop(*[f"__k{i}" for i in range(len(keys))])


def _sortable(column: Column, kind: T.DataType) -> Column:
    if is_clock(kind):
        return clock_micros(column, kind)
    if isinstance(kind, T.NumericType):
        return column
    raise SpecError(f"median does not take {kind.simpleString()}")


def _midpoint(low: Column, high: Column, kind: T.DataType) -> Column:
    """Half-way between two sortable values, as a value of ``kind``."""
    if is_clock(kind):
        # Half a microsecond goes away from the epoch.
        both = low.cast("decimal(20,0)") + high
        return micros_clock(F.round(both / 2), kind)
    if isinstance(kind, T.DecimalType):
        # Half a unit of the last digit is cut towards zero.
        both = low + high
        unit = F.lit(Decimal(2).scaleb(-kind.scale)).cast(T.DecimalType(38, kind.scale))
        return ((both - both % unit) / 2).cast(kind)
    # Halves are taken first: the sum of two large values may pass the type.
    middle = F.when(low == high, low.cast("double")).otherwise(low.cast("double") / 2 + high.cast("double") / 2)
    return middle.cast("float") if isinstance(kind, T.FloatType) else middle


DIGIT_BITS, KEY_BITS = 16, 64
MANTISSA, BIAS = 52, 1023


def has_key(kind: T.DataType) -> bool:
    """Whether values of the type have a 64-bit key."""
    return is_clock(kind) or isinstance(kind, T.NumericType) and not (isinstance(kind, T.DecimalType) and kind.precision > 18)


def _whole(column: Column, kind: T.DataType) -> Column:
    """The key of an integer, a time or a decimal."""
    value = _sortable(column, kind)
    if isinstance(kind, T.DecimalType):
        return (value * F.lit(Decimal(10) ** kind.scale).cast(T.DecimalType(kind.scale + 1, 0))).cast("long")
    return value.cast("long")


def _with_double_keys(rows: DataFrame, x: str, key: str) -> DataFrame:
    """``key`` of the doubles in ``x`` by exponent and mantissa; 0.0 and -0.0 have one key. Steps are columns, so each is computed once."""
    power = lambda n: F.pow(F.lit(2.0), n)
    size, guess = F.abs(x), F.col("__guess")
    rows = rows.withColumn("__guess", F.least(F.floor(F.log2(size)), F.lit(BIAS)))
    rows = rows.withColumn("__power", power(guess))
    # The logarithm may round over a power of two: one step back or on.
    step = F.when(F.col("__power") > size, -1).when((guess < BIAS) & (F.col("__power") * 2 <= size), 1).otherwise(0)
    rows = rows.withColumn("__exponent", guess + step)
    exponent = F.col("__exponent")
    ordinary = F.shiftleft(exponent + BIAS, MANTISSA) + ((size * power(-exponent) - 1) * float(1 << MANTISSA)).cast("long")
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    top = 2 * BIAS + 1 << MANTISSA
    size_key = F.when(size == float("inf"), F.lit(top)).when(size < 2.0 ** (1 - BIAS), tiny).otherwise(ordinary)
    rows = rows.withColumn("__size", F.when(F.isnan(x), F.lit(top + 1)).otherwise(size_key))
    return rows.withColumn(key, F.when(F.col(x) < 0, -F.col("__size")).otherwise(F.col("__size"))).drop("__guess", "__power", "__exponent", "__size")


def with_keys(rows: DataFrame, x: Column, kind: T.DataType, key: str) -> DataFrame:
    """``rows`` with ``key``, an integer of the same order as the values ``x``; NULL stays NULL."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        keyed = _with_double_keys(rows.withColumn("__x", x.cast("double")), "__x", key)
        return keyed.withColumn(key, F.when(F.col("__x").isNotNull(), F.col(key))).drop("__x")
    return rows.withColumn(key, _whole(x, kind))


def key_value(key: Column, kind: T.DataType) -> Column:
    """The sortable value that a key stands for."""
    if isinstance(kind, T.DecimalType):
        unit = F.lit(Decimal(1).scaleb(-kind.scale)).cast(T.DecimalType(kind.scale + 1, kind.scale))
        return (key.cast("decimal(18,0)") * unit).cast(kind)
    if not isinstance(kind, T.FractionalType):
        return key
    size = F.abs(key)
    exponent, mantissa = F.shiftright(size, MANTISSA), size.bitwiseAND((1 << MANTISSA) - 1).cast("double")
    ordinary = (1 + mantissa / float(1 << MANTISSA)) * F.pow(F.lit(2.0), F.least(exponent, F.lit(2 * BIAS)) - BIAS)
    tiny = mantissa * 2.0**-537 * 2.0**-537
    top = 2 * BIAS + 1
    value = F.when(exponent == 0, tiny).when(exponent < top, ordinary).when(mantissa == 0, float("inf")).otherwise(float("nan"))
    return F.when(key < 0, -value).otherwise(value)


LARGEST = 1.7976931348623157e308


def _slice_of(inside: Column) -> Column:
    """Number of the equal-width slice of the range a value lies in; below it, -1. Infinities are in the end slices."""
    half = lambda c: F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)) / 2
    low, high = half(F.col("__lo")), half(F.col("__hi"))
    number = F.when(high > low, F.floor((half(inside) - low) / (high - low) * SLICES)).otherwise(0)
    return F.when(inside.isNotNull(), F.least(number, F.lit(SLICES - 1)).cast("int")).otherwise(-1)


def _middle_keys(rows: DataFrame, groups: Sequence[str], accuracy: int) -> DataFrame:
    """``groups`` with ``__low`` and ``__high``, the values at the middle ranks of ``__v``, which has no NULL, and the ranks."""
    margin = 3.0 / accuracy
    sketch = F.percentile_approx("__v", [0.5 - margin, 0.5 + margin], accuracy)
    bounds = rows.groupBy(*groups).agg(sketch.alias("__b"), F.count("__v").alias("__n"), F.count_if("__nan").alias("__nans"))
    bounds = bounds.select(
        *groups, "__n", "__nans", F.element_at("__b", 1).alias("__lo"), F.element_at("__b", 2).alias("__hi")
    )
    if isinstance(rows.schema["__v"].dataType, T.LongType):
        # The sketch keeps doubles: 64-bit integers come back rounded, by less than this.
        slack, end = 2048, (1 << 63) - 1
        lower = F.greatest(F.col("__lo"), F.lit(slack - end)) - slack
        bounds = bounds.withColumn("__lo", lower).withColumn("__hi", F.least(F.col("__hi"), F.lit(end - slack)) + slack)

    # NULL in __c collects the rows below the range, and those above it in a slice of their own, in single counted
    # entries. (A filter on __v would make the optimiser repeat the whole key in its inferred conditions.) The hint
    # keeps Spark from broadcasting the rows of a small table; a hot group is a skewed join, which Spark splits.
    near = null_safe_join(rows, bounds.hint("shuffle_hash"), groups)
    inside = F.when((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")), F.col("__v"))
    counted = (
        near.select(*groups, "__n", "__nans", inside.alias("__c"), F.when(F.col("__v") > F.col("__hi"), SLICES).otherwise(_slice_of(inside)).alias("__s"))
        .groupBy(*groups, "__n", "__nans", "__s", "__c")
        .agg(F.count(F.lit(1)).alias("__rows"))
    )
    low_rank = F.floor((F.col("__n") + 1) / 2)
    high_rank = F.floor(F.col("__n") / 2) + 1

    # Which slices hold the middle ranks, and how many rows lie before each.
    slices = counted.groupBy(*groups, "__n", "__s").agg(F.sum("__rows").alias("__size"))
    upto = F.sum("__size").over(Window.partitionBy(*groups).orderBy("__s"))
    placed = slices.withColumn("__before", upto - F.col("__size"))
    holding = placed.filter((F.col("__before") < high_rank) & (F.col("__before") + F.col("__size") >= low_rank))

    # Only those slices are put in order.
    chosen = null_safe_join(counted, holding.select(*groups, "__s", "__before"), [*groups, "__s"])
    running = Window.partitionBy(*groups, "__s").orderBy(F.col("__c").asc_nulls_first())
    ranked = chosen.withColumn("__cum", F.col("__before") + F.sum("__rows").over(running))
    picked = ranked.groupBy(*groups, "__n", "__nans").agg(
        F.min(F.when(F.col("__cum") >= low_rank, F.col("__c"))).alias("__low"),
        F.min(F.when(F.col("__cum") >= high_rank, F.col("__c"))).alias("__high"),
        F.bool_or(F.col("__c").isNull() & (F.col("__cum") >= low_rank)).alias("__missed"),
    )
    # The sketch's rank bound rules both cases out; a wrong median must never pass.
    safe = F.when(
        F.col("__missed") | F.col("__high").isNull(),
        F.raise_error(F.lit("median rank fell outside the sketch range")).cast(picked.schema["__low"].dataType),
    ).otherwise(F.col("__low"))
    return picked.select(*groups, "__n", "__nans", low_rank.alias("__low_rank"), high_rank.alias("__high_rank"), safe.alias("__low"), "__high")


def exact_median(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    alias: str,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Groups ``__g0``, ... (NULL is one; a constant without keys) and the exact median of ``col``; NaN comes last.

    Groups without a value are left out.
    """
    kind = field_of(df.schema, col).dataType
    value = _sortable(column_of(df.schema, col), kind)
    real = isinstance(kind, (T.FloatType, T.DoubleType))
    # NaN stands with the infinite values and is told from them by its count, as it has the last ranks.
    nan = F.isnan(value) if real else F.lit(False)
    value = F.when(nan, float("inf")).otherwise(value.cast("double")) if real else value
    named = [(f"__g{i}", F.col(f"`{k}`")) for i, k in enumerate(keys)] or [("__g0", F.lit(1))]
    groups = [name for name, _ in named]
    rows = df.select(*[c.alias(n) for n, c in named], value.alias("__v"), nan.alias("__nan")).where(F.col("__v").isNotNull())
    found = _middle_keys(rows, groups, accuracy)
    ends = [F.when(F.col("__nans") > 0, F.when(F.col(rank) > F.col("__n") - F.col("__nans"), float("nan")).otherwise(F.col(c))).otherwise(F.col(c)) if real else F.col(c)
            for c, rank in (("__low", "__low_rank"), ("__high", "__high_rank"))]
    return found.select(*groups, _midpoint(*ends, kind).alias(alias))


def value_at_rank(df: DataFrame, col: str, rank: int) -> object:
    """The ``rank``-th smallest non-NULL value of ``col`` (1-based), or None past the end; one row reaches the driver.

    Types without a key (texts, wide decimals) are sorted up to the rank by Spark.
    """
    kind = field_of(df.schema, col).dataType
    if rank < 1:
        return None
    if not has_key(kind):
        values = df.select(column_of(df.schema, col).alias("v")).where(F.col("v").isNotNull())
        row = values.orderBy("v").offset(rank - 1).limit(1).first()
        return row and row["v"]
    rows = with_keys(df.select(column_of(df.schema, col).alias("v")), F.col("v"), kind, "k").where(F.col("k").isNotNull()).select("k")
    found, left = None, rank
    for done in range(DIGIT_BITS, KEY_BITS + 1, DIGIT_BITS):
        below = rows if found is None else rows.where(F.shiftright("k", KEY_BITS - done + DIGIT_BITS) == found)
        counts = below.groupBy(F.shiftright("k", KEY_BITS - done).alias("p")).agg(F.count("*").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("p")))  # at most 65,536 rows
        row = upto.where(F.col("upto") >= left).agg(F.min(F.struct("p", "n", "upto")).alias("m")).first()["m"]
        if row is None:
            return None
        found, left = row["p"], left - (row["upto"] - row["n"])
    value = key_value(F.lit(found).cast("long"), kind)
    return df.sparkSession.range(1).select((micros_clock(value, kind) if is_clock(kind) else value).cast(kind)).first()[0]
