"""Sharding by extendible hashing.

A document's bucket is named by the first bits of a hash of its id. A bucket of more bytes than
the limit is split on its next bit, and so on; other buckets are left alone. So the directory is
deep only where the data are dense. Bytes are counted once by fine cells of the hash; the
directory follows from their sums. A cell that is still too large is counted again by finer
cells. Where one id alone has more bytes than fit, its rows go by a hash of their place instead;
a row larger than the limit is a shard by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiweave.llm.common import scratch, whole_text, written

#: Bits of the hash, bits by which cells are finer than the mean shard, and bits of a further round.
BITS, FINER, ROUND = 60, 4, 8


RESULT = {"shard": "string", "depth": "int", "shard_bytes": "bigint", "shard_rows": "bigint"}


def hashed(value: Column) -> Column:
    """The first 60 bits of the MD5 of a value's text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(hash60: Column, depth: int) -> Column:
    """The first ``depth`` bits."""
    return F.call_function("shiftright", hash60, F.lit(BITS) - depth)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """The buckets (depth, prefix, bytes, rows) of ``rows`` (hash, bytes), each within the limit or of one hash."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, math.ceil(math.log2(max(1, total / limit))) + FINER)
    found, above, rest = None, 0, rows
    while True:
        cells = written(
            rest.groupBy(prefix(F.col("hash"), depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")), "cells"
        )
        levels = cells.select("*", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("depth"))
        levels = levels.select("depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("prefix"), "bytes", "rows")
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        last = depth == BITS
        fits = sums.where((F.col("bytes") <= limit) | (F.lit(last) & (F.col("depth") == BITS)))
        # A bucket is in the directory if it fits and the bucket above it does not.
        parents = sums.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        leaves = fits.withColumn("up", F.expr("shiftright(prefix, 1)")).join(parents, ["depth", "up"], "left_semi")
        tops = fits.where(F.col("depth") == above) if found is None else fits.limit(0)
        level = written(leaves.select("depth", "prefix", "bytes", "rows").unionByName(tops.select("depth", "prefix", "bytes", "rows")), "directory")
        found = level if found is None else found.unionByName(level)
        large = sums.where((F.col("depth") == depth) & (F.col("bytes") > limit)).select(F.col("prefix").alias("cell"))
        if last or large.isEmpty():
            return found
        rest = rest.join(large, prefix(F.col("hash"), depth) == F.col("cell"), "left_semi")
        above, depth = depth, min(BITS, depth + ROUND)


def assign(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (the bits of its bucket, as text), ``depth`` and the bytes and rows of the shard.

    Null texts count no bytes; a null id hashes as the empty text. Equal ids share a shard unless they
    do not fit into one. An empty table has no shards.
    """
    sized = docs.withColumns({"__hash": hashed(F.col(doc_id)), "__bytes": F.octet_length(whole_text(text)).cast("long")})
    found = directory(sized.select(F.col("__hash").alias("hash"), F.col("__bytes").alias("bytes")), limit)
    crowded = found.where((F.col("bytes") > limit) & (F.col("rows") > 1))
    if not crowded.isEmpty():
        # Ids with more bytes than a shard holds: their rows are dealt by their places.
        keys = crowded.select(F.col("prefix").alias("__hash"), F.lit(True).alias("__many"))
        placed = sized.withColumn("__row", F.monotonically_increasing_id()).join(keys, "__hash", "left")
        by_row = hashed(F.concat_ws(":", F.col("__hash").cast("string"), F.col("__row").cast("string")))
        sized = written(placed.withColumn("__hash", F.when(F.col("__many"), by_row).otherwise(F.col("__hash"))).drop("__many", "__row"), "dealt")
        found = directory(sized.select(F.col("__hash").alias("hash"), F.col("__bytes").alias("bytes")), limit)
    found = written(found, "found")
    depths = sorted(r["depth"] for r in found.select("depth").distinct().collect())  # at most 61
    if not depths:
        return sized.drop("__hash", "__bytes").select("*", *[F.lit(None).cast(t).alias(n) for n, t in RESULT.items()])
    named = found.select(
        F.col("depth").alias("__depth"),
        F.col("prefix").alias("__prefix"),
        F.expr("CASE WHEN depth = 0 THEN '' ELSE lpad(conv(prefix, 10, 2), depth, '0') END").alias("shard"),
        F.col("depth"),
        F.col("bytes").alias("shard_bytes"),
        F.col("rows").alias("shard_rows"),
    )
    # Buckets are looked up on the different finest cells, not on the rows.
    finest = depths[-1]
    cells = sized.select(prefix(F.col("__hash"), finest).alias("__cell")).distinct()
    tries = F.array(*[F.struct(F.lit(d).alias("d"), F.expr(f"shiftright(__cell, {finest - d})").alias("p")) for d in depths])
    tried = cells.withColumn("__try", F.explode(tries)).select("__cell", F.col("__try.d").alias("__depth"), F.col("__try.p").alias("__prefix"))
    # Written, so that Spark knows its size and need not shuffle the texts where it is small.
    placed = written(tried.join(named, ["__depth", "__prefix"]).drop("__depth", "__prefix"), "placed")
    return sized.withColumn("__cell", prefix(F.col("__hash"), finest)).join(placed, "__cell").drop("__cell", "__hash", "__bytes")


def write_shards(assigned: DataFrame, path: str | None = None) -> str:
    """One folder ``shard=b...`` of Parquet for each shard; the path. Large shards are written by several tasks."""
    path = path or scratch(assigned.sparkSession, "shards")
    named = assigned.withColumn("shard", F.concat(F.lit("b"), F.col("shard")))
    named.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
    return path


def read_shards(docs_like: DataFrame, path: str) -> DataFrame:
    """The rows of written shards with their shard."""
    back = docs_like.sparkSession.read.schema(docs_like.schema).parquet(path)
    return back.withColumn("shard", F.expr("substring(shard, 2)"))
