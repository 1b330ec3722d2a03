"""Benchmark decontamination by winnowing.

A window is SPAN words in a row. The hashes of the GRAM-word grams in it are compared and the
least is kept, on both sides: a text and an item that share a window share its fingerprint, so
joining fingerprints loses no shared span of SPAN words or more. Hits are then extended: all
windows of the texts that were hit are joined with the items' windows themselves. An item of
fewer words is one window of its own length, and its one gram is its fingerprint.

Everything is made of built-in functions and joins. Arrays made by chained functions are exploded
in the outer form: for the inner one the optimiser filters by a copy of the whole expression,
which would be computed again for every element. Which side of a join is small is left to
Spark, which measures it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiweave.llm.common import lower_ascii, whole_text, written

#: What a word is made of: ASCII digits, lower-case letters and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, GRAM = 10, 5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _places(count: Column, length: int) -> Column:
    """0 to the last place where ``length`` words begin; none where there are fewer."""
    none = F.array().cast("array<int>")
    return F.when(count >= length, F.sequence(F.lit(0), count - length)).otherwise(none)


def _grams(hashes: str, length: int) -> Column:
    """A hash of each ``length`` words in a row."""
    return F.transform(
        _places(F.size(hashes), length),
        lambda i: F.xxhash64(F.lit(length), *[F.get(F.col(hashes), i + j) for j in range(length)]),
    )


def with_fingerprints(df: DataFrame, words: str, result: str, lengths: list[int]) -> DataFrame:
    """The different fingerprints of all windows of ``lengths`` words (SPAN: winnowed grams)."""
    df = df.withColumn("__hash", F.transform(words, lambda w: F.xxhash64(w)))
    parts = []
    if SPAN in lengths:
        df = df.withColumn("__gram", _grams("__hash", GRAM))
        least = lambda i: F.least(*[F.get(F.col("__gram"), i + j) for j in range(SPAN - GRAM + 1)])
        parts.append(F.array_distinct(F.transform(_places(F.size(words), SPAN), least)))
    parts += [F.array_distinct(_grams("__hash", n)) for n in lengths if n < SPAN]
    return df.withColumn(result, F.concat(*parts) if parts else F.array().cast("array<bigint>")).drop("__hash", "__gram")


def windows_at(words: str, lengths: list[int]) -> Column:
    """Structures (place, length, window) of all windows of ``lengths`` words."""

    def of(n: int) -> Column:
        window = lambda i: F.array_join(F.slice(F.col(words), i + 1, n), " ").alias("window")
        return F.transform(_places(F.size(words), n), lambda i: F.struct(i.alias("place"), F.lit(n).alias("length"), window(i)))

    return F.concat(*map(of, lengths))


def find_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
              item_text: str = "text") -> DataFrame:
    """One row for each document: its id, ``text_key`` (a hash of its text), ``n_words``, ``n_hit`` and ``items``.

    ``n_hit``: words inside any occurrence of a window of an item; ``items``: the ids of those items as
    sorted text. Null and empty texts have no words, nor have null items windows; items without id
    count for words only. Repeated rows get a row each, alike; further columns are left out.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(whole_text(item_text)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("length", F.least(F.lit(SPAN), F.size("words")))
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most SPAN
    base = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("t"))
    base = base.select("id", "t", F.xxhash64("t", F.octet_length("t")).alias("key"))
    if not lengths:
        counted = base.select("id", "key", F.size(words_of(F.col("t"))).cast("long").alias("n_words"))
        return counted.select(
            F.col("id").alias(doc_id), F.col("key").alias("text_key"), "n_words", F.lit(0).cast("long").alias("n_hit"),
            F.array().cast("array<string>").alias("items"),
        )
    windows, prints = [], []
    for n in lengths:
        own = items.where(F.col("length") == n)
        spread = own.select("item", F.explode_outer(windows_at("words", [n])).alias("w")).where("w is not null")
        windows.append(spread.select("item", "w.length", "w.window"))
        prints.append(with_fingerprints(own, "words", "prints", [n]).select(F.explode_outer("prints").alias("print")).where("print is not null"))
    item_windows = windows[0]
    item_prints = prints[0]
    for more, other in zip(windows[1:], prints[1:], strict=True):
        item_windows, item_prints = item_windows.unionByName(more), item_prints.unionByName(other)
    item_windows = written(item_windows.distinct(), "windows")
    item_prints = written(item_prints.distinct(), "prints")

    read = base.withColumn("words", words_of(F.col("t")))
    read = with_fingerprints(read, "words", "prints", lengths)
    read = written(read.select("id", "key", F.size("words").cast("long").alias("n_words"), "prints"), "documents")
    hit = read.select("id", "key", F.explode("prints").alias("print")).join(item_prints, "print", "left_semi")
    hit = written(hit.select("id", "key").distinct(), "hit")

    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])
    texts = base.join(hit, same(base, hit), "left_semi").dropDuplicates(["id", "key"])
    spread = texts.withColumn("words", words_of(F.col("t"))).select("id", "key", F.explode_outer(windows_at("words", lengths)).alias("w"))
    spread = spread.where("w is not null").select("id", "key", "w.place", "w.length", "w.window")
    found = written(spread.join(item_windows.select("length", "window").distinct(), ["length", "window"], "left_semi"), "found")

    ordered = F.sort_array(F.collect_list(F.struct("place", "length")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["place"] + x["length"] - F.greatest(acc["end"], x["place"]))).alias("n"),
            F.greatest(acc["end"], x["place"] + x["length"]).alias("end"),
        ),
    )
    hits = found.groupBy("id", "key").agg(ordered.alias("spans")).select("id", "key", covered["n"].alias("n_hit"))
    pairs = found.select("id", "key", "length", "window").distinct().join(item_windows, ["length", "window"]).select("id", "key", "item")
    named = pairs.distinct().groupBy("id", "key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    named = named.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "items")
    both = hits.join(named, hits["id"].eqNullSafe(named["id2"]) & (hits["key"] == named["key2"]), "left")
    both = both.select(F.col("id").alias("id3"), F.col("key").alias("key3"), "n_hit", "items")
    counts = read.select("id", "key", "n_words")
    out = counts.join(both, counts["id"].eqNullSafe(both["id3"]) & (counts["key"] == both["key3"]), "left")
    return out.select(
        F.col("id").alias(doc_id),
        F.col("key").alias("text_key"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns whose texts hold no window of the benchmark."""
    hits = find_hits(docs, benchmark, doc_id, text).where("n_hit > 0")
    bad = hits.select(F.col(doc_id).alias("__id"), F.col("text_key").alias("__key")).distinct()
    t = whole_text(text)
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(t, F.octet_length(t)) == F.col("__key")), "left_anti")
