"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections.

A text is cut, without losing a character, into paragraphs (through their line ends) and these
into sentences (through their end marks). Hashes of sentences make the hash of a paragraph,
those of FANOUT paragraphs the hash of a section, those of sections the root. Roots tell
whether texts are equal; going down from differing roots along differing hashes locates edits.

A fingerprint is a string of four parts, ``root|sections|paragraphs|sentences``: comma-joined
hashes in text order, paragraphs with the number of their sentences as ``hash:count``. Only the
root is a full hash; the others are the first SHORT hex digits of theirs.

Everything is made of built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiweave.llm.common import whole_text

PARAGRAPH = r"[^\n]*\n+|[^\n]+"
SENTENCE = r"[^\n.!?]*[\n.!?]+|[^\n.!?]+"
FANOUT, SHORT = 8, 8
#: Rows that one sorted run of ids holds about, and the most runs (their first rows are broadcast).
RUN_ROWS, MOST_RUNS = 1000, 2048
#: Sorts before any id: where a null id stands.
NO_ID = -(1 << 63)


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, ",")


def _short(hashes: Column) -> Column:
    return F.transform(hashes, lambda h: F.substring(h, 1, SHORT))


def with_fingerprint(df: DataFrame, text: str, result: str) -> DataFrame:
    """``df`` with the fingerprint of a column of texts (null: as empty) under the name ``result``.

    The empty text has a root and no branches. Equal texts have equal fingerprints; further columns stay.
    """
    leaves, paragraphs, sections = (f"__{result}_{x}" for x in ("leaves", "paragraphs", "sections"))
    cut = F.regexp_extract_all(whole_text(text), F.lit(PARAGRAPH), F.lit(0))
    sentences = lambda p: F.transform(F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0)), lambda s: F.md5(s.cast("binary")))
    groups = F.sequence(F.lit(0), F.ceil(F.size(paragraphs) / FANOUT).cast("int") - 1)
    return (
        df.withColumn(leaves, F.transform(cut, sentences))
        .withColumn(paragraphs, F.transform(leaves, lambda x: F.md5(F.array_join(x, "").cast("binary"))))
        .withColumn(
            sections,
            F.when(F.size(paragraphs) == 0, F.array().cast("array<string>")).otherwise(
                F.transform(groups, lambda i: F.md5(F.array_join(F.slice(paragraphs, i * FANOUT + 1, FANOUT), "").cast("binary")))
            ),
        )
        .withColumn(
            result,
            F.concat_ws(
                "|",
                F.sha2(F.array_join(sections, "").cast("binary"), 256),
                _joined(_short(F.col(sections))),
                _joined(
                    F.zip_with(paragraphs, leaves, lambda p, x: F.concat(F.substring(p, 1, SHORT), F.lit(":"), F.size(x).cast("string")))
                ),
                _joined(_short(F.flatten(leaves))),
            ),
        )
        .drop(leaves, paragraphs, sections)
    )


def leaves_of(fingerprint: Column) -> Column:
    """The different short hashes of sentences in a fingerprint."""
    return F.array_distinct(F.split(F.substring_index(fingerprint, "|", -1), ","))


def likeness(one: Column, other: Column) -> Column:
    """Twice the common different sentences over the sum of both numbers; 1 for equal roots."""
    a, b = leaves_of(one), leaves_of(other)
    same = F.substring_index(one, "|", 1) == F.substring_index(other, "|", 1)
    return F.when(same, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def changed_branches(one: Column, other: Column) -> Column:
    """Numbers (from 0) of the paragraphs whose hashes differ at their place, below sections that differ."""
    part = lambda f, i: F.split(F.element_at(F.split(f, r"\|"), i), ",")
    s1, s2, p1, p2 = part(one, 2), part(other, 2), part(one, 3), part(other, 3)
    longest = F.greatest(F.size(p1), F.size(p2))
    differs = lambda a, b, i: ~F.get(a, i).eqNullSafe(F.get(b, i))
    return F.filter(
        F.sequence(F.lit(0), longest - 1),
        lambda i: differs(s1, s2, F.floor(i / FANOUT).cast("int")) & differs(p1, p2, i),
    )


def with_next(docs: DataFrame, doc_id: str, text: str, result: str) -> DataFrame:
    """``docs`` with the text of the next document in descending order of the ids; after the last comes the first.

    The ids are cut into runs at quantiles. The first row of each run is also given to the run
    before it, so that a window within each run finds every next text: one shuffle, no global
    sort. Equal ids are in the order of their texts; null ids come last; a null text becomes the empty one.
    """
    spark = docs.sparkSession
    key, run = "__key", "__run"
    keyed = docs.withColumn(key, F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))).withColumn(text, whole_text(text))
    ids = keyed.select(key)
    runs = min(MOST_RUNS, 1 + ids.count() // RUN_ROWS)
    bounds = sorted(set(ids.approxQuantile(key, [i / runs for i in range(1, runs)], 0.2 / runs))) if runs > 1 else []

    def place(low: int, high: int) -> Column:
        """How many bounds lie at or below the key, found by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(key) < F.lit(int(bounds[middle])), place(low, middle)).otherwise(place(middle + 1, high))

    keyed = keyed.withColumn(run, place(0, len(bounds)))
    heads = sorted((r[run], r["head"]) for r in keyed.groupBy(run).agg(F.max(key).alias("head")).collect())
    before = [(h, heads[(i + 1) % len(heads)][0]) for i, (_, h) in enumerate(heads)]
    given = spark.createDataFrame(before or [(NO_ID, -1)], f"{key} bigint, __to int")
    spread = keyed.join(F.broadcast(given), key, "left").withColumn(
        "__at",
        F.explode(
            F.when(
                F.col("__to").isNotNull(),
                F.array(F.struct(F.col(run).alias("r"), F.lit(0).alias("g")), F.struct(F.col("__to").alias("r"), F.lit(1).alias("g"))),
            ).otherwise(F.array(F.struct(F.col(run).alias("r"), F.lit(0).alias("g"))))
        ),
    )
    order = Window.partitionBy(F.col("__at.r")).orderBy(F.col("__at.g"), F.col(key).desc(), F.col(text))
    return (
        spread.withColumn(result, F.lead(text).over(order))
        .where(F.col("__at.g") == 0)
        .drop(key, run, "__to", "__at")
    )


def edited(text: Column, following: Column) -> Column:
    """The last half (rounded down) of the characters replaced by the first as many of the next text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))
