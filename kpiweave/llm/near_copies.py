"""N-gram Jaccard join by universe partition and the pigeonhole principle.

The set of a text is its different word shingles. Sizes are cut into bands such that linked sets
lie in one band or in two neighbouring ones. For a band, the most differences D that two linked
sets of it can have is known; hashing cuts the universe of shingles into segments. Of m segments,
d also allow for one difference: sets are indexed there by their shingles in the segment, whole
and with each one left out. If m + d > D, linked sets agree in a segment, so none is missed. For
each band m and d are chosen by an estimate of rows and false candidates.

Such an index takes several times the texts' bytes, so only texts that can have a link are in it.
Of a text's set, at most ``100 - least`` percent may be missing in a linked one. A census of a part of
the universe (of small sets: of all of it) finds the shingles that occur in one set only; a set
with more of them than that has no link and is left out of the index.

Groups of many near copies are not spelled out as pairs. In each bucket every set is compared with
the bucket's most connected set only; then only pairs of sets that are still in different
components, and whose bit sketches do not rule a link out, are compared. Comparisons are exact,
on the sets themselves (64-bit hashes of shingles).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.llm.common import slices, whole_text, written

RUN_BYTES = 2 << 20
#: Bytes of the words that a task keeps with their hashes, about; bytes of a word that is kept; bytes of an entry beside it.
TABLE_BYTES, KEPT_BYTES, ENTRY_BYTES = 32 << 20, 200, 170
#: Sets that a task knows as sent.
SEEN_ROWS = 200_000
#: Entries of the index that a task has, and that it sorts at once, about; links that one task compares with one set.
PART_ENTRIES, SORTED_ENTRIES, DEGREE = 2_000_000, 400_000, 400
#: Share of shingles that unrelated texts are taken to have in common; an estimate for costs only.
COMMON = 0.2
#: Entries of the index that cost as much as one false meeting, about; an estimate too.
MEETING = 8
#: Largest set of which the census takes all shingles; what the shares of larger sets are out of.
SMALL_SET, SHARES = 160, 4096
#: Members of a bucket that are compared in a task; larger buckets are cut into blocks of about so many.
MEMBERS = 8192
#: Bytes of a key in the index, and texts whose entries are packed together (their places have two bytes).
KEY_BYTES, PACKED_TEXTS = 6, 60_000
SKETCH_BITS, BITMAP_BITS = 4096, 25
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))) * _ODD[1]
    x = (x ^ (x >> np.uint64(31))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[4]
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Hashes of words, each computed once while the table is kept; long words are not kept."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_BYTES:
            if self.held > TABLE_BYTES:
                self.clear()
                self.held = 0
            self.held += ENTRY_BYTES + len(word)
            self[word] = value
        return value


def shingles(text: bytes, words: Words, length: int) -> np.ndarray:
    """The different shingles of a text, sorted; a text of fewer words is one, a text without words none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    if len(parts) < length:
        total = hashes[:1] * _ODD[0] + np.uint64(len(parts))
        for h in hashes[1:]:
            total = mix(total) + h
        return mix(total, 1)
    places = len(parts) - length + 1
    total = hashes[:places].copy()
    for j in range(1, length):
        total = mix(total) + hashes[j : j + places]
    return np.unique(mix(total, 2))


class Bands:
    """Size bands and segments for a threshold of ``least`` percent."""

    def __init__(self, least: int, counts: dict[int, int] | None = None) -> None:
        self.least, self.counts = least, counts or {}
        self.starts, self.plans = [1], {}

    def largest(self, size: int) -> int:
        """The largest set that a set of ``size`` can be linked with."""
        return 100 * size // self.least

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.largest(self.starts[-1]) + 1)
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def differences(self, band: int) -> int:
        """The most differences between linked sets of which the smaller is in the band."""
        self.band(self.starts[-1])
        top = self.starts[band + 1] - 1
        both = top + self.largest(top)
        return (100 - self.least) * both // (100 + self.least)

    def plan(self, band: int) -> tuple[int, int]:
        """(segments, those that allow for one difference) of least estimated cost."""
        if band not in self.plans:
            while len(self.starts) < band + 2:
                self.band(self.starts[-1])
            need = self.differences(band) + 1
            size, texts = self.starts[band], self.counts.get(band, 1)

            def cost(m: int) -> float:
                d, load = need - m, 2 * (1 - COMMON) * size / m
                meet = (m - d) * math.exp(-load) + d * math.exp(-load) * (1 + load)
                return texts * (m + d * size / m) + MEETING * texts * texts / 2 * meet

            low = -(-need // 2)
            tried = sorted({low + round(i * (need - low) / 16) for i in range(17)})
            best = min(tried, key=lambda m: (cost(m), m))
            self.plans[band] = (best, need - best)
        return self.plans[band]

    def keys(self, tokens: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The index keys of a set, in its own band and as the larger partner of the band below."""
        own, out = self.band(len(tokens)), []
        for band in (own, own - 1):
            if band < 0:
                continue
            m, d = self.plan(band)
            place = (tokens % np.uint64(m)).astype(np.int64)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, place, values)
            tag = (np.arange(m, dtype=np.uint64) + np.uint64(band << 32)) * _ODD[2]
            out.append(mix(sums + tag, 3))
            if d:
                inside = place < d
                out.append(mix((sums[place] - values + tag[place])[inside], 3))
        return np.unique(np.concatenate(out))


def sketch(tokens: np.ndarray) -> bytes:
    """Bits flipped once for each shingle: two sets differ at least as much as their sketches."""
    bits = np.bincount((mix(tokens, 4) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def packed_parts(keys: list[np.ndarray], owner: list[int], parts: int) -> tuple[np.ndarray, list[bytes]]:
    """The parts that the keys belong to, and for each its entries: the nodes once, then key and place of the node.

    Six bytes of a key are kept: within a part they tell keys apart all but always, and a rare
    false meeting is only compared in vain.
    """
    all_keys = np.concatenate(keys)
    place = np.repeat(np.arange(len(owner), dtype=np.uint16), [len(k) for k in keys])
    part = (mix(all_keys, 7) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    nodes, cuts = np.array(owner, np.uint64), []
    for at in np.split(order, first[1:]):
        mine, index = np.unique(place[at], return_inverse=True)
        short = np.ascontiguousarray(all_keys[at]).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        cuts.append(struct.pack("<I", len(mine)) + nodes[mine].tobytes() + index.astype(np.uint16).tobytes() + short.tobytes())
    return found, cuts


def unpacked(data: bytes) -> np.ndarray:
    """Rows (key, node) of packed entries."""
    (count,) = struct.unpack_from("<I", data)
    nodes = np.frombuffer(data, np.uint64, count, 4)
    at = 4 + 8 * count
    n = (len(data) - at) // (2 + KEY_BYTES)
    rows = np.zeros((n, 2), np.uint64)
    rows[:, 1] = nodes[np.frombuffer(data, np.uint16, n, at)]
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :KEY_BYTES] = np.frombuffer(data, np.uint8, n * KEY_BYTES, at + 2 * n).reshape(n, KEY_BYTES)
    rows[:, 0] = keys.view(np.uint64)[:, 0]
    return rows


def linked(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least * (len(a) + len(b) - both)


def share(least: int) -> int:
    """Of SHARES parts of the universe, those in which the census counts sets of more than SMALL_SET shingles too.

    Enough to find more than ``100 - least`` percent of a set there where most of its shingles are its own.
    """
    return min(SHARES, SHARES // 10 + SHARES * (100 - least) // 80)


def shared_part(tokens: np.ndarray, least: int) -> np.ndarray:
    """Marks the shingles in the part of the universe that is counted for sets of any size."""
    return tokens % np.uint64(SHARES) < np.uint64(share(least))


def _texts(docs: DataFrame, length: int) -> DataFrame:
    """(id, said, size, node, check, sketch) of each text: its own hash, its set's size, two hashes and bit sketch."""
    fields = (("said", T.LongType()), ("size", T.LongType()), ("node", T.LongType()), ("check", T.LongType()), ("sketch", T.BinaryType()))
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *(T.StructField(n, k) for n, k in fields)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            at = 0
            for run in slices(batch.column("text"), RUN_BYTES):
                sets = [shingles(text or b"", words, length) for text in run.to_pylist()]
                sums = [[int(mix(x, salt).sum(dtype=np.uint64)) for x in sets] for salt in (5, 6)]
                columns = [
                    batch.column("id").slice(at, len(sets)),
                    batch.column("said").slice(at, len(sets)),
                    pa.array([len(x) for x in sets], pa.int64()),
                    *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in sums],
                    pa.array([sketch(x) for x in sets], pa.binary()),
                ]
                at += len(sets)
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("id", "said", "text").mapInArrow(scan, schema)


def two_of_each(keys: list[np.ndarray]) -> list[np.ndarray]:
    """The keys of different sets, but of each key only those of the first two sets that have it."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    third = np.zeros(len(every), bool)
    third[order[2:]] = every[order[2:]] == every[order[:-2]]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    return [k[~t] for k, t in zip(keys, np.split(third, ends), strict=True)]


def _census(docs: DataFrame, length: int, least: int, parts: int) -> DataFrame:
    """Packed rows (part, entries) of the shingles that are counted, and the nodes of their sets.

    Of the sets of a run two entries are enough to show that a shingle is in several: further ones are not
    sent, so a shingle that all texts have is not many entries in one task.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for batch in batches:
            for run in slices(batch.column("text"), RUN_BYTES):
                if len(seen) > SEEN_ROWS:  # never within a run: its sets are different
                    seen.clear()
                keys, owner = [], []
                for text in run.to_pylist():
                    tokens = shingles(text or b"", words, length)
                    node = int(mix(tokens, 5).sum(dtype=np.uint64))
                    if len(tokens) and node not in seen:
                        seen.add(node)
                        keys.append(tokens if len(tokens) <= SMALL_SET else tokens[shared_part(tokens, least)])
                        owner.append(node)
                keys = two_of_each(keys) if keys else keys
                for at in range(0, len(keys), PACKED_TEXTS):
                    found, cuts = packed_parts(keys[at : at + PACKED_TEXTS], owner[at : at + PACKED_TEXTS], parts)
                    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(cuts, pa.binary())], ["part", "entries"])

    return docs.select("text").mapInArrow(scan, "part int, entries binary")


def _singles(packed: DataFrame, least: int) -> DataFrame:
    """(node, alone, alone_shared): how many of a set's counted shingles no other set has, and of these in the shared part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.concatenate([unpacked(x) for x in b.column("entries").to_pylist()]) for b in batches if len(b)]
        turns = np.uint64(max(1, -(-sum(map(len, held)) // SORTED_ENTRIES)))
        for turn in range(int(turns) if held else 0):
            rows = np.concatenate([x[x[:, 0] % turns == turn] for x in held])
            order = np.argsort(rows[:, 0], kind="stable")
            key, node = rows[order, 0], rows[order, 1]
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            alone = np.minimum.reduceat(node, first) == np.maximum.reduceat(node, first)
            key, node = key[first[alone]], node[first[alone]]
            nodes, place = np.unique(node, return_inverse=True)
            shared = np.bincount(place[shared_part(key, least)], minlength=len(nodes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.view(np.int64)), pa.array(np.bincount(place, minlength=len(nodes)).astype(np.int32)), pa.array(shared.astype(np.int32))],
                ["node", "alone", "alone_shared"],
            )

    found = packed.mapInArrow(count, "node bigint, alone int, alone_shared int")
    return found.groupBy("node").agg(F.sum("alone").alias("alone"), F.sum("alone_shared").alias("alone_shared"))


def _linkable(texts: DataFrame, singles: DataFrame, least: int) -> DataFrame:
    """(node, said, size) of the sets that can have a link: at most ``100 - least`` percent of their shingles are known to be theirs alone.

    Sets of which linked ones may be larger than SMALL_SET are judged by the shared part only, as those
    are counted only there.
    """
    nodes = texts.where("size > 0").groupBy("node").agg(F.min("said").alias("said"), F.min("size").alias("size"))
    alone = F.when(F.col("size") * 100 < (SMALL_SET + 1) * least, F.col("alone")).otherwise(F.col("alone_shared"))
    kept = 100 * F.coalesce(alone, F.lit(0)) <= (100 - least) * F.col("size")
    return nodes.join(singles, "node", "left").where(kept).select("node", "said", "size")


def _bitmap(said: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the hashes ``said``; it tells most others apart, not all."""
    bits = said.select((_bit() / 64).cast("int").alias("slot"), F.expr("shiftleft(1L, cast(pmod(said, 64) as int))").alias("bit"))
    slots = bits.groupBy("slot").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    table = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    table[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy()
    return table


def _bit() -> Column:
    return F.pmod("said", F.lit(1 << BITMAP_BITS))


def _marked(batch: pa.RecordBatch, bitmap: np.ndarray) -> pa.Array:
    """The texts of a batch whose bit ``h`` is in the bitmap."""
    h = batch.column("h").to_numpy()
    return batch.filter(pa.array((bitmap[h >> 6] >> (h & 63)) & 1 == 1)).column("text")


def _index(docs: DataFrame, bands: Bands, length: int, parts: int, only: DataFrame | None = None) -> DataFrame:
    """Packed rows (part, entries) of the index keys and nodes of the texts; a task packs equal sets once.

    With ``only`` (said): of the texts with these hashes, and a few more. They go straight into the shuffle,
    as they are the bulk of what is kept on disk.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(None if only is None else _bitmap(only))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for batch in batches:
            wanted = batch.column("text") if bitmap.value is None else _marked(batch, bitmap.value)
            for run in slices(wanted, RUN_BYTES):
                keys, owner = [], []
                for text in run.to_pylist():
                    tokens = shingles(text or b"", words, length)
                    values = mix(tokens, 5)
                    node = int(values.sum(dtype=np.uint64))
                    if len(tokens) and node not in seen:
                        if len(seen) > SEEN_ROWS:
                            seen.clear()
                        seen.add(node)
                        keys.append(bands.keys(tokens, values))
                        owner.append(node)
                for at in range(0, len(keys), PACKED_TEXTS):
                    found, cuts = packed_parts(keys[at : at + PACKED_TEXTS], owner[at : at + PACKED_TEXTS], parts)
                    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(cuts, pa.binary())], ["part", "entries"])

    columns = ["text"] if only is None else ["text", _bit().alias("h")]
    return docs.select(*columns).mapInArrow(scan, "part int, entries binary")


def _buckets(packed: DataFrame) -> DataFrame:
    """(key, node, size) of the buckets that hold different sets."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.concatenate([unpacked(x) for x in b.column("entries").to_pylist()]) for b in batches if len(b)]
        # Sorting takes several copies of the rows: some keys at a time, which share their remainder.
        turns = np.uint64(max(1, -(-sum(map(len, held)) // SORTED_ENTRIES)))
        for turn in range(int(turns) if held else 0):
            rows = np.concatenate([x[x[:, 0] % turns == turn] for x in held])
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            twin = rows[1:, 0] == rows[:-1, 0]  # most keys stand alone: drop them before the finer sort
            rows = rows[np.concatenate([[False], twin]) | np.concatenate([twin, [False]])] if len(rows) else rows
            rows = np.unique(rows, axis=0)
            if not len(rows):
                continue
            first = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            count = np.diff(np.append(first, len(rows)))
            size = np.repeat(count, count)
            rows, size = rows[size > 1].view(np.int64), size[size > 1]
            for at in range(0, len(rows), 100_000):
                part = rows[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(size[at : at + 100_000].astype(np.int64))], ["key", "node", "size"]
                )

    return packed.mapInArrow(group, "key bigint, node bigint, size bigint")


def _possible(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out."""

    @F.arrow_udf("boolean")
    def may_link(size_a: pa.Array, size_b: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
        bits = [np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(len(x), SKETCH_BITS // 64) for x in (one, other)]
        total = size_a.to_numpy() + size_b.to_numpy()
        most = total - 2 * -(-least * total // (100 + least))
        return pa.array(np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1) <= most)

    side = lambda n: nodes.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("sketch").alias(f"sketch_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(may_link("size_a", "size_b", "sketch_a", "sketch_b")).select("a", "b")


def _verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, length: int, least: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are linked; ``firsts`` (node, said): the hash of a text of each node.

    The sets are computed again from the texts, of those nodes alone. Texts are told by their hashes, never
    by ids, and a set counts as the node that it has by itself. All sets to be compared with b
    meet in a task, or in several for a much compared b, each with its own copy of b's set.
    """
    degree = pairs.groupBy("b").agg(F.ceil(F.count("*") / DEGREE).cast("int").alias("salts"))
    to = F.struct("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("is_b"))
    members = pairs.join(degree, "b").select(F.col("a").alias("node"), to.alias("to"))
    centre = F.struct("b", F.col("salt").cast("int").alias("salt"), F.lit(True).alias("is_b"))
    centres = degree.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(F.col("b").alias("node"), centre.alias("to"))
    targets = written(members.unionByName(centres).join(firsts, "node").select("said", "node", "to"), "targets")

    # Most texts that are not needed are left out; a few may get through.
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(targets))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for batch in batches:
            for run in slices(_marked(batch, bitmap.value), RUN_BYTES):
                nodes, found = [], []
                for text in run.to_pylist():
                    tokens = shingles(text or b"", words, length)
                    node = mix(tokens, 5).sum(dtype=np.uint64).view(np.int64).item()
                    # Copies within the task are sent once.
                    if len(tokens) and node not in seen:
                        if len(seen) > SEEN_ROWS:
                            seen.clear()
                        seen.add(node)
                        nodes.append(node)
                        found.append(tokens.tobytes())
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["node", "set"])

    found = docs.select("text", _bit().alias("h")).mapInArrow(sets, "node bigint, set binary")
    rows = found.join(targets.select("node", "to"), "node").select("node", "to.*", "set").dropDuplicates(["node", "b", "salt", "is_b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            good = []
            for b, salt, is_b, node, data in zip(*(batch.column(n).to_pylist() for n in ("b", "salt", "is_b", "node", "set")), strict=True):
                tokens = np.frombuffer(data, np.uint64)
                if is_b:
                    at, centre = (b, salt), tokens
                elif at == (b, salt) and linked(centre, tokens, least):
                    good.append((node, b))
            if good:
                yield pa.RecordBatch.from_pydict({"a": pa.array([g[0] for g in good], pa.int64()), "b": pa.array([g[1] for g in good], pa.int64())})

    ordered = rows.select("b", "salt", "is_b", "node", "set").repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("is_b").desc())
    return written(ordered.mapInArrow(compare, "a bigint, b bigint"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of the edges (a, b), by alternating stars."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        # Large star: neighbours above a node go to the least neighbour (or the node itself).
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: neighbours below a node, and the node, go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())


def _across(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Pairs of a bucket in different components that sizes and sketches do not rule out.

    Buckets of more than MEMBERS are cut into blocks: a component with many members into blocks of its
    own, the others by component. Each two blocks with different components meet in a group, so a task
    has about two blocks, and a component is never compared with itself.
    """
    named = buckets.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    named = written(named, "named")
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("total"))
    mixed = written(mixed.where("x <> y").select("key", "total"), "mixed")
    block = F.struct(F.lit(False).alias("own"), F.lit(0).cast("long").alias("of"), F.lit(0).cast("long").alias("salt"))
    few = named.join(mixed.where(F.col("total") <= MEMBERS).select("key"), "key")
    meeting = few.select("key", "node", "label", block.alias("one"), block.alias("other"), F.lit(0).alias("side"))
    many = mixed.where(F.col("total") > MEMBERS).select("key")
    if not many.isEmpty():
        inside = named.join(many, "key")
        n = F.col("n")
        sizes = written(inside.groupBy("key", "label").agg(F.count("*").alias("n")).withColumn("own", n > MEMBERS // 8), "sizes")
        rest = sizes.groupBy("key").agg(F.ceil(F.sum(F.when(F.col("own"), 0).otherwise(n)) / MEMBERS).alias("shared"))
        placed = inside.join(sizes.join(rest, "key"), ["key", "label"])
        salt = lambda c, count: F.pmod(F.xxhash64(c), F.greatest(F.lit(1), count)).cast("long")
        own = F.struct("own", F.col("label").alias("of"), salt("node", F.ceil(n / MEMBERS)).alias("salt"))
        shared = F.struct("own", F.lit(0).cast("long").alias("of"), salt("label", F.col("shared")).alias("salt"))
        placed = written(placed.select("key", "node", "label", F.when(F.col("own"), own).otherwise(shared).alias("block")), "placed")
        blocks = placed.select("key", "block").distinct()
        twos = blocks.withColumnRenamed("block", "one").join(blocks.withColumnRenamed("block", "other"), "key")
        twos = twos.where("one <= other and not (one.own and other.own and one.of = other.of)")
        twos = written(twos, "block-pairs")
        for side, name in enumerate(("one", "other")):
            put = twos.where("one <> other") if side else twos
            put = put.withColumn("block", F.col(name))
            rows = placed.join(put, ["key", "block"]).select("key", "node", "label", "one", "other", F.lit(side).alias("side"))
            meeting = meeting.unionByName(rows)
    members = meeting.join(nodes, "node")

    def pairs(group: pa.Table) -> pa.Table:
        label, side = group.column("label").to_numpy(), group.column("side").to_numpy()
        order = np.lexsort((label, side))
        label, side = label[order], side[order]
        node, size = (group.column(n).to_numpy()[order] for n in ("node", "size"))
        bits = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(node), SKETCH_BITS // 64)[order]
        # Two blocks: the first with the second. One block: each with those of later components.
        firsts = int(np.searchsorted(side, 1))
        both = firsts < len(node)
        start = np.full(firsts, firsts) if both else np.searchsorted(label, label, side="right")
        one, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, at in enumerate(start.tolist()):
            total = size[at:] + size[i]
            far = np.bitwise_count(bits[at:] ^ bits[i]).sum(axis=1)
            hit = node[at:][far <= total - 2 * -(-least * total // (100 + least))]
            if len(hit):
                one.append(np.full(len(hit), node[i]))
                other.append(hit)
        a, b = np.concatenate(one), np.concatenate(other)
        return pa.table({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})

    return members.groupBy("key", "one", "other").applyInArrow(pairs, "a bigint, b bigint").distinct()


def _groups(docs: DataFrame, doc_id: str, text: str, length: int, least: int) -> DataFrame:
    """(id, said, size, component_id, kept) of each row: ``said`` is its text's hash, ``kept`` marks its group's first (id, said)."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("text")).withColumn("said", F.xxhash64("text"))
    parted = lambda entries: max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * entries // PART_ENTRIES))
    texts = written(_texts(base, length), "texts")
    counted = F.when(F.col("size") <= SMALL_SET, F.col("size")).otherwise(F.col("size") * share(least) / SHARES)
    parts = parted(int(texts.agg(F.sum(counted)).first()[0] or 0))
    census = _census(base, length, least, parts).repartition(parts, "part")
    linkable = written(_linkable(texts, _singles(census, least), least), "linkable")
    # Sets by size band, for the choice of segments only.
    probe = Bands(least)
    counts: dict[int, int] = {}
    for row in linkable.groupBy(F.floor(F.log("size") * 10).cast("int").alias("g")).count().collect():
        band = probe.band(max(1, int(math.exp((row["g"] + 0.5) / 10))))
        for near in (band, band + 1):
            counts[near] = counts.get(near, 0) + -(-row["count"] // 2)
    estimate = Bands(least, counts)
    parts = parted(sum(n * sum(estimate.plan(b)) for b, n in counts.items()))
    packed = _index(base, Bands(least, counts), length, parts, linkable.select("said")).repartition(parts, "part")
    buckets = written(_buckets(packed), "buckets")
    popular = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    classes = texts.where("size > 0").groupBy("node").agg(F.min("said").alias("said"), F.min("size").alias("size"), F.min("sketch").alias("sketch"))
    held = written(popular.join(classes, "node"), "held")
    weighed = buckets.select("key", "node").join(held.select("node", "weight"), "node")
    centre = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("c")).select("key", F.col("c.node").alias("centre"))
    stars = buckets.select("key", "node").join(centre, "key").where("node <> centre")
    stars = stars.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    stars = written(_possible(stars, held.select("node", "size", "sketch"), least), "stars")
    firsts = held.select("node", "said")
    links = _verified(stars, firsts, base, length, least)
    labels = components(links)
    seen = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = written(_across(buckets, labels, held.select("node", "size", "sketch"), least).join(seen, ["a", "b"], "left_anti"), "across")
    if not rest.isEmpty():
        labels = components(links.unionByName(_verified(rest, firsts, base, length, least)))
    # Sets without links are told apart by a second hash as well.
    grouped = texts.join(labels, "node", "left").withColumn("class", F.struct(F.coalesce("label", "node"), F.when(F.col("label").isNull(), F.col("check"))))
    grouped = grouped.select("id", "said", "size", F.when(F.col("size") > 0, F.col("class")).alias("class"))
    # Groups of more than one row are few against the rows: only they are joined.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "said"))
    firsts = grouped.where("size > 0").groupBy("class").agg(first.alias("first"), F.count("*").alias("rows")).where("rows > 1")
    out = grouped.join(written(firsts.select("class", "first"), "firsts"), "class", "left")
    component = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id"))
    kept = F.col("first").isNull() | (F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.said") == F.col("said")))
    return out.select("id", "said", "size", component.alias("component_id"), kept.alias("kept"))


def find_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 5, least: int = 80) -> DataFrame:
    """One row for each document: its id, ``n_shingles`` and ``component_id``, the least id reachable by links.

    Two texts link if 100 * |common shingles| >= ``least`` * |all shingles|. A-Z are lowered; words are
    what ASCII white space parts. Fewer than ``length`` words are one shingle. Null, empty and wordless
    texts link with nothing and keep their own id. Repeated rows and equal sets are one class from the
    start. Rows without id link like others and take the least id of their group; where none has one the
    component is null. Rows that repeat an id at another text each have their own text's links; they do not
    join their groups. Further columns are left out; an empty table gives an empty table.
    """
    found = _groups(docs, doc_id, text, length, least)
    return found.select(F.col("id").alias(doc_id), F.col("size").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 5, least: int = 80) -> DataFrame:
    """The first row of each group of ``docs``, the one with the least id, with all its columns.

    Of rows with the same id and text one stays; rows with the same id and texts that are not linked all
    stay, and of linked ones the text with the least hash. A row without id stands behind all others of its
    group (ids are taken to be below 2 ** 62), by a hash of its text.
    """
    said = F.xxhash64(whole_text(text))
    stand_in = F.lit(1 << 62) + F.shiftrightunsigned(said, 2)
    keyed = docs.withColumn("__key", F.coalesce(F.col(doc_id).cast("long"), stand_in)).withColumn("__said", said)
    groups = written(_groups(keyed, "__key", text, length, least).select(F.col("id").alias("__key"), F.col("said").alias("__said"), "kept"), "groups")
    # The rows that go are few and written, so Spark knows their size and shuffles the texts only if it must.
    losers = written(groups.where("not kept").select("__key", "__said").distinct(), "losers")
    rows = keyed.join(losers, ["__key", "__said"], "left_anti")
    repeated = groups.where("kept").groupBy("__key", "__said").count().where("count > 1")
    return (rows if repeated.isEmpty() else rows.dropDuplicates(["__key", "__said"])).drop("__key", "__said")
