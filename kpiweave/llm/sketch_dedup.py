"""Near copies by fast similarity sketching, banding and exact verification.

The set of a text is its different word shingles. A sketch has COORDS coordinates, filled in rounds:
in each of the first COORDS rounds every shingle is hashed into one coordinate; in the next ones
round COORDS + c puts all shingles into coordinate c. A value is the round and then the hash, the
least stays, and a set is done after the first round that leaves no coordinate empty. So each
coordinate fills, long sets are done after a round or two, and the share of equal coordinates of
two sets keeps to their likeness as closely as with independent hash functions.

Sets that agree in all coordinates of a band are candidates. Two sets of likeness 0.8 agree in one
of BANDS bands of WIDTH but for a chance of 5e-8. Pairs are not spelled out. In each bucket every set
is first compared with the bucket's least set. Then sets of a bucket that are still in different
components are compared with each other, and of each set and of two components only the few closest
pairs are sent on; where pairs were held back a next round sends more, until none is left that is
neither ruled out nor confirmed or refused on the full sets. A bucket of more than MEMBERS sets is split by the other bands of its sets there: pairs that share two bands meet again in
smaller buckets (likeness 0.8 shares no second band with a chance of 1e-6).

A pair is ruled out by sizes, by parities of PARITY_BITS hashed bits, of which linked sets cannot differ
in more than their difference, or where fewer than AGREEING coordinates agree (at likeness 0.8, seven
standard deviations below the mean). Links are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.llm.common import slices, whole_text, written
from kpiweave.llm.near_copies import Words, components, linked, mix, shingles

COORDS, WIDTH = 128, 4
BANDS = COORDS // WIDTH
AGREEING = 70
RUN_BYTES = 1 << 20
#: Sets of a bucket compared in one task; sets that one task compares with one set.
MEMBERS, DEGREE = 4096, 400
BITMAP_BITS, PARITY_BITS = 25, 2048
#: Closest pairs of a set, and of two components, in the first round of comparisons; growth by round.
CLOSEST, GROWTH = 8, 4


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches (len(sets), COORDS) of non-empty sets of 64-bit numbers."""
    out = np.full((len(sets), COORDS), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for turn in range(2 * COORDS):
        hashed = mix(items, 100 + turn)
        bins = (hashed >> np.uint64(57)).astype(np.int64) if turn < COORDS else turn - COORDS
        value = (hashed & np.uint64((1 << 55) - 1)) | np.uint64(turn << 55)
        np.minimum.at(flat, owner * COORDS + bins, value)
        # Values of later rounds are greater, so a set is done once no coordinate is empty.
        open_ = (out == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        left = open_[owner]
        items, owner = items[left], owner[left]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """BANDS keys of each sketch."""
    parts = sketch.reshape(len(sketch), BANDS, WIDTH)
    total = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(WIDTH):
        total = mix(total) + parts[:, :, j]
    return mix(total, 9)


def marks(sketch: np.ndarray) -> np.ndarray:
    """A byte of each coordinate: unlike coordinates agree in it once in 256 times."""
    return (mix(sketch, 11) >> np.uint64(56)).astype(np.uint8)


def parity(tokens: np.ndarray) -> bytes:
    """Bits flipped once for each number: two sets differ at least as much as their parities."""
    bits = np.bincount((mix(tokens, 4) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def most_differences(total: np.ndarray, least: int) -> np.ndarray:
    """The most that two linked sets of ``total`` members together can differ in."""
    return total - 2 * -(-least * total // (100 + least))


def nodes(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two hashes of each set."""
    return [np.array([mix(s, salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (5, 6)]


def text_key(text: Column) -> Column:
    """A hash of a text, so that texts are found again whatever their ids are."""
    return F.xxhash64(text)


def _sketched(base: DataFrame, length: int) -> DataFrame:
    """(id, said, size, node, check, keys, marks, parity) of each text of ``base`` (id, said, text)."""
    fields = (("said", T.LongType()), ("size", T.LongType()), ("node", T.LongType()), ("check", T.LongType()), ("keys", T.ArrayType(T.LongType())), ("marks", T.BinaryType()), ("parity", T.BinaryType()))
    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), *(T.StructField(n, k) for n, k in fields)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            at = 0
            for run in slices(batch.column("text"), RUN_BYTES):
                sets = [shingles(text or b"", words, length) for text in run.to_pylist()]
                full = np.flatnonzero([len(s) for s in sets])
                keys, bits = [None] * len(sets), [b""] * len(sets)
                found = sketches([sets[i] for i in full])
                for i, k, m in zip(full.tolist(), band_keys(found).view(np.int64), marks(found), strict=True):
                    keys[i], bits[i] = k, m.tobytes()
                columns = [batch.column("id").slice(at, len(sets)), batch.column("said").slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64())]
                columns += [*map(pa.array, nodes(sets)), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array([parity(x) for x in sets], pa.binary())]
                at += len(sets)
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return base.select("id", "said", "text").mapInArrow(scan, schema)


def _possible(pairs: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that sizes, parities and sketches do not rule out."""

    @F.arrow_udf("boolean")
    def may_link(size_a: pa.Array, size_b: pa.Array, one: pa.Array, other: pa.Array, flips: pa.Array, others: pa.Array) -> pa.Array:
        packed = lambda x, kind: np.frombuffer(b"".join(x.to_pylist()), kind).reshape(len(x), -1)
        agree = (packed(one, np.uint8) == packed(other, np.uint8)).sum(axis=1) >= AGREEING
        differ = np.bitwise_count(packed(flips, np.uint64) ^ packed(others, np.uint64)).sum(axis=1)
        return pa.array(agree & (differ <= most_differences(size_a.to_numpy() + size_b.to_numpy(), least)))

    side = lambda n: held.select(F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("size", "marks", "parity")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b"))
    return both.where(may_link("size_a", "size_b", "marks_a", "marks_b", "parity_a", "parity_b")).select("a", "b")


def _linked(pairs: DataFrame, held: DataFrame, base: DataFrame, length: int, least: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose full sets are linked.

    Sets are computed again from the texts of these nodes alone. A node's text is told by its hash,
    and a set only counts if it has the node's own hash. All sets that are compared with b meet in
    a task, or in several, each with a copy of b's set.
    """
    degree = pairs.groupBy("b").agg(F.ceil(F.count("*") / DEGREE).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt")
    members = pairs.join(degree, "b").select(F.col("a").alias("node"), "b", salt, F.lit(False).alias("is_b"))
    centres = degree.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("is_b"))
    targets = written(members.unionByName(centres).join(held.select("node", "said"), "node"), "targets")

    # A bitmap of fixed size drops most texts that are not needed; it may let others through.
    bits = targets.select(F.pmod("said", F.lit(1 << BITMAP_BITS)).alias("h")).distinct()
    slots = bits.groupBy((F.col("h") / 64).cast("int").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    table[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy()
    bitmap = base.sparkSession.sparkContext.broadcast(table)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for batch in batches:
            said = batch.column("said").to_numpy()
            h = said & ((1 << BITMAP_BITS) - 1)
            kept = batch.filter(pa.array((bitmap.value[h >> 6] >> (h & 63)) & 1 == 1))
            for run in slices(kept.column("text"), RUN_BYTES):
                found = []
                for text in run.to_pylist():
                    found.append(shingles(text or b"", words, length))
                first, _ = nodes(found)
                # Copies in the task are sent once; the sets meet again in the shuffle anyhow.
                fresh = [i for i, n in enumerate(first.tolist()) if n not in seen and not seen.add(n) and len(found[i])]
                if len(seen) > 500_000:
                    seen.clear()
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array(first[fresh]), pa.array([found[i].tobytes() for i in fresh], pa.binary())], ["node", "set"])

    found = base.select("said", "text").mapInArrow(sets, "node bigint, set binary")
    rows = found.join(targets.select("node", "b", "salt", "is_b"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            good = set()
            for b, salt, is_b, node, data in zip(*(batch.column(n).to_pylist() for n in ("b", "salt", "is_b", "node", "set")), strict=True):
                if is_b:
                    at, centre = (b, salt), np.frombuffer(data, np.uint64)
                elif at == (b, salt) and linked(centre, np.frombuffer(data, np.uint64), least):
                    good.add((node, b))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], ["a", "b"])

    ordered = rows.select("b", "salt", "is_b", "node", "set").repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("is_b").desc())
    return written(ordered.mapInArrow(compare, "a bigint, b bigint"), "links")


def _stars(buckets: DataFrame) -> DataFrame:
    """(a, b): each set of a bucket (key, node) with the bucket's least set."""
    least = buckets.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").drop("top")
    return buckets.join(least, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, total) of the buckets that hold sets of different components."""
    named = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    several = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("total")).where("x < y")
    return named.join(several.select("key", "total"), "key")


def _across(buckets: DataFrame, held: DataFrame, refused: DataFrame, least: int, closest: int) -> DataFrame:
    """Pairs (a, b) in different components of mixed buckets that nothing rules out and that are not in ``refused``.

    By two blocks of a bucket a task; of each set and of each two components the ``closest`` pairs.
    ``more`` marks the pairs of a bucket (key) where others were held back.
    """
    cuts = F.ceil(F.col("total") / MEMBERS).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    placed = buckets.withColumn("cuts", cuts).withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    meeting = placed.select("key", "node", "label", "mine", F.least("mine", "theirs").alias("one"), F.greatest("mine", "theirs").alias("other"))
    known = refused.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("refused"))

    def pairs(group: pa.Table) -> pa.Table:
        key = group.column("key")[0].as_py()
        node, size, label, mine, one, other = (group.column(n).to_numpy() for n in ("node", "size", "label", "mine", "one", "other"))
        tested = {(a, b) for a, bs in zip(node.tolist(), group.column("refused").to_pylist(), strict=True) for b in bs or ()}
        packed = lambda c, kind: np.frombuffer(b"".join(group.column(c).to_pylist()), kind).reshape(len(node), -1)
        order = np.lexsort((label, mine))
        marks, flips = packed("marks", np.uint8)[order], packed("parity", np.uint64)[order]
        node, size, label, mine = (x[order] for x in (node, size, label, mine))
        # Two blocks: the first with the second. One block: each set with those of later components.
        border = int(np.searchsorted(mine, other[0])) if one[0] != other[0] else 0
        starts = np.full(border, border) if border else np.searchsorted(label, label, side="right")
        best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        more = False
        for i, at in enumerate(starts.tolist()):
            total = size[at:] + size[i]
            far = np.bitwise_count(flips[at:] ^ flips[i]).sum(axis=1)
            near = np.flatnonzero((far <= most_differences(total, least)) & (label[at:] != label[i]))
            near = near[100 * np.minimum(size[at:][near], size[i]) >= least * np.maximum(size[at:][near], size[i])]
            near = near[(marks[at:][near] == marks[i]).sum(axis=1) >= AGREEING]
            taken = 0
            for j in near[np.argsort(far[near], kind="stable")].tolist():
                pair = max(node[i], node[at + j]).item(), min(node[i], node[at + j]).item()
                if pair not in tested:
                    if taken == closest:
                        more = True
                        break
                    two = min(label[i], label[at + j]), max(label[i], label[at + j])
                    best.setdefault(two, []).append((int(far[j]), *pair))
                    if len(best[two]) > 2 * closest:
                        best[two], more = sorted(best[two])[:closest], True
                    taken += 1
        more = more or any(len(pairs) > closest for pairs in best.values())
        found = [x[1:] for pairs in best.values() for x in sorted(pairs)[:closest]]
        columns = [*(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)), pa.array([key] * len(found), pa.int64()), pa.array([more] * len(found), pa.bool_())]
        return pa.table(columns, ["a", "b", "key", "more"])

    members = meeting.join(held, "node").join(known, "node", "left")
    return members.groupBy("key", "one", "other").applyInArrow(pairs, "a bigint, b bigint, key bigint, more boolean")


def find_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 5, least: int = 80) -> DataFrame:
    """One row for each document: its id, ``n_shingles``, ``component_id`` (the least id reachable by links) and ``kept``.

    Two texts link if 100 * |common shingles| >= ``least`` * |all shingles|; ``least`` is 80 or more.
    A-Z are lowered; words are what ASCII white space parts. Fewer than ``length`` words are one
    shingle. Null, empty and wordless texts link with nothing and keep their own id. Equal sets are
    one class from the start, whatever their ids. A null id is greater than all others; a group of
    null ids alone has a null component and its rows are kept. Rows that repeat an id at another
    text each have their own text's group. Further columns are left out; an empty table gives an
    empty table.
    """
    if least < 80:
        raise ValueError("the bands are made for a likeness of 80 percent or more")
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("text")).withColumn("said", text_key(F.col("text")))
    texts = written(_sketched(base, length), "sketched")
    keyed = texts.select("node", F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = written(keyed.join(shared, "key").select("key", "node"), "buckets")
    met = texts.join(buckets.select("node").distinct(), "node", "left_semi")
    met = met.groupBy("node").agg(F.min(F.struct("said", "size", "marks", "parity")).alias("s"))
    held = written(met.select("node", "s.said", "s.size", "s.marks", "s.parity"), "held")
    looks = held.drop("said")
    links = _linked(written(_possible(_stars(buckets), looks, least), "stars"), held, base, length, least)
    labels = written(components(links), "labels")
    mixed = written(_mixed(buckets, labels), "mixed")
    large = mixed.where(F.col("total") > MEMBERS).select("key", "node")
    if not large.isEmpty():
        # Buckets of pairs that share two bands; those of one component need no comparison.
        finer = large.withColumnRenamed("key", "outer").join(buckets, "node").where("key <> outer")
        finer = finer.select(F.xxhash64(F.least("key", "outer"), F.greatest("key", "outer")).alias("key"), "node").distinct()
        small = mixed.where(F.col("total") <= MEMBERS)
        mixed = written(small.unionByName(_mixed(written(finer, "finer"), labels)), "mixed")
    refused = spark.createDataFrame([], "a bigint, b bigint")
    closest = CLOSEST
    while True:
        sent = written(_across(mixed, looks, refused, least, closest), "across")
        pairs = written(sent.select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():
            break
        found = _linked(pairs, held, base, length, least)
        links = links.unionByName(found)
        labels = written(components(links), "labels")
        held_back = sent.where("more").select("key").distinct()
        if held_back.isEmpty():
            break
        failed = pairs.join(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
        refused = written(refused.unionByName(failed), "refused")
        mixed = written(_mixed(mixed.join(held_back, "key").select("key", "node"), labels), "mixed")
        closest *= GROWTH
    # Sets without links are told apart by a second hash as well.
    grouped = texts.select("id", "size", "node", "check").join(labels, "node", "left")
    group = F.struct(F.coalesce("label", "node").alias("label"), F.when(F.col("label").isNull(), F.col("check")).alias("check"))
    grouped = grouped.select("id", "size", F.when(F.col("size") > 0, group).alias("class"))
    # Groups of more than one row are few against the rows: only they are joined.
    ids = grouped.where("size > 0").groupBy("class").agg(F.min("id").alias("least_id"), F.count("*").alias("rows")).where("rows > 1").select("class", "least_id")
    out = grouped.join(written(ids, "ids"), "class", "left")
    component = F.when(F.col("least_id").isNotNull(), F.col("least_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
