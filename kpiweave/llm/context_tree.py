"""Language-model scores by context-tree weighting.

Each byte is coded as eight binary decisions in the context of the DEPTH bytes before it. In the
tree of contexts a node has, for each decision, the counts of zeros and ones and their
Krichevsky-Trofimov estimate; weighting mixes the estimates of all depths by how well they have
coded the training text. With frozen counts the code length of a byte depends on the byte and its
context alone, so it is computed once for each different (context, byte).

No model is gathered in one place. Texts are packed into blocks. A block lists its different
grams (context and byte) and words with their training counts; parts of the lists (grams by the
two latest bytes, words by hash) from all blocks meet in a task, which merges them, computes the
values and sends back to each block those of its own items, in the block's own order. The levels
above two bytes have at most 256 * 255 nodes, which alone go through the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.llm.common import slices, whole_text, written

DEPTH, END_BYTE = 4, 255
BLOCK_BYTES = 6 << 20
#: Bits of a gram's place in a block, beside the 40 of the gram.
PLACE_BITS = 23
#: Bytes of text for each item of a block's list, about, and items that a part has, about.
BYTES_PER_ITEM, PART_ITEMS = 30, 1_500_000
WORDS, GRAMS = 0, 1
ITEMS = "kind int, part int, block bigint, items binary, counts binary"
VALUES = "kind int, part int, block bigint, values binary"
HALF = np.log(0.5)


# ---- the tree

def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series behind eight steps of the recurrence."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of the counts."""
    half = log_gamma(np.array([0.5]))[0]
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - 2 * half - log_gamma(zeros + ones + 1.0)


def chance_of_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def decisions(byte: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node within the byte, bit) of each of the eight decisions."""
    for k in range(8):
        yield (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


class Level:
    """The nodes (context * 256 + place within the byte) of one depth, sorted, with their counts."""

    def __init__(self, contexts: np.ndarray, byte: np.ndarray, counts: np.ndarray) -> None:
        keys = np.concatenate([contexts * 256 + node for node, _ in decisions(byte)])
        bits = np.concatenate([bit for _, bit in decisions(byte)])
        self.keys, at = np.unique(keys, return_inverse=True)
        every = np.tile(counts, 8)
        self.ones = np.bincount(at, every * bits, len(self.keys))
        self.zeros = np.bincount(at, every * (1 - bits), len(self.keys))
        self.estimate = log_estimate(self.zeros, self.ones)
        self.weighted, self.stay = self.estimate, np.ones(len(self.keys))

    def mix(self, below: Level) -> None:
        """Weights the node's own estimate against the product of its children's."""
        parents = np.searchsorted(self.keys, (below.keys >> 16) * 256 + (below.keys & 255))
        self.join(np.bincount(parents, below.weighted, len(self.keys)))

    def join(self, children: np.ndarray) -> None:
        self.weighted = np.logaddexp(HALF + self.estimate, HALF + children)
        self.stay = np.exp(HALF + self.estimate - self.weighted)


def lower_levels(grams: np.ndarray, counts: np.ndarray) -> list[Level]:
    """The levels of depth 2 to DEPTH for grams: latest byte first, the coded byte last."""
    byte, contexts = (grams & 255).astype(np.int64), (grams >> 8).astype(np.int64)
    levels = [Level(contexts >> (8 * (DEPTH - d)), byte, counts.astype(np.float64)) for d in range(2, DEPTH + 1)]
    for upper, below in zip(levels[-2::-1], levels[:0:-1], strict=True):
        upper.mix(below)
    return levels


def upper_levels(rows: np.ndarray) -> np.ndarray:
    """[stay, chance of one] for the nodes of depth 1 (latest byte * 256 + place) and then of depth 0.

    ``rows``: node of depth 1, zeros, ones, and the sum of ln weighted probabilities of its children.
    """
    dense = np.zeros((3, 1 << 16))
    dense[:, rows[:, 0].astype(np.int64)] = rows[:, 1:].T
    out = []
    for _ in range(2):
        zeros, ones, children = dense
        estimate = log_estimate(zeros, ones)
        weighted = np.logaddexp(HALF + estimate, HALF + children)
        out.append(np.stack([np.exp(HALF + estimate - weighted), chance_of_one(zeros, ones)], axis=1))
        dense = np.stack([x.reshape(-1, 256).sum(axis=0) for x in (zeros, ones, weighted)])
    return np.concatenate(out)


def log10_chances(grams: np.ndarray, levels: list[Level], upper: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context."""
    byte, contexts = (grams & 255).astype(np.int64), (grams >> 8).astype(np.int64)
    latest = contexts >> (8 * (DEPTH - 1))
    total = np.zeros(len(grams))
    for node, bit in decisions(byte):
        chance = None
        for d in range(DEPTH, 1, -1):
            level = levels[d - 2]
            at = np.searchsorted(level.keys, (contexts >> (8 * (DEPTH - d))) * 256 + node)
            own = chance_of_one(level.zeros[at], level.ones[at])
            chance = own if chance is None else level.stay[at] * own + (1 - level.stay[at]) * chance
        for row in (upper[latest * 256 + node], upper[(1 << 16) + node]):
            chance = row[:, 0] * row[:, 1] + (1 - row[:, 0]) * chance
        total += np.log10(np.where(bit == 1, chance, 1 - chance))
    return total


# ---- blocks

def packed_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened_batch(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, data): runs of about BLOCK_BYTES of text, each packed into one value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, held, size
            data = packed_batch(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            row = pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "data": pa.array([data], pa.binary())})
            number, held, size = number + 1, [], 0
            return row

        for batch in batches:
            at = 0
            for run in slices(batch.column("text"), BLOCK_BYTES // 4):
                held.append(batch.slice(at, len(run)))
                at += len(run)
                size += pa.compute.sum(pa.compute.binary_length(run)).as_py() or 0
                if size >= BLOCK_BYTES:
                    yield block()
        if sum(len(b) for b in held):
            yield block()

    return docs.mapInArrow(pack, "block bigint, data binary")


def grams_of(texts: list[bytes]) -> np.ndarray:
    """All (context, byte) of the texts in order; a text begins after zeros and ends with END_BYTE."""
    data = np.frombuffer(bytes(DEPTH) + (bytes((END_BYTE,)) + bytes(DEPTH)).join(texts) + bytes((END_BYTE,)), np.uint8).astype(np.uint64)
    codes = data[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        codes |= data[DEPTH - back : len(data) - back] << np.uint64(8 * (DEPTH + 1 - back))
    real = np.ones(len(codes), bool)
    ends = np.cumsum([len(t) + 1 + DEPTH for t in texts])[:-1]
    for k in range(DEPTH):  # the zeros before a text are context only
        real[ends - 1 - k] = False
    return codes[real]


def ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes (of 40 bits), sorted, and the place of each code among them; ``codes`` is overwritten."""
    if len(codes) <= 1 << PLACE_BITS:  # code and place in one number: sorted faster than an order is found
        codes <<= np.uint64(PLACE_BITS)
        codes |= np.arange(len(codes), dtype=np.uint64)
        codes.sort()
        at = (codes & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int32)
        codes >>= np.uint64(PLACE_BITS)
    else:
        at = np.argsort(codes)
        codes = codes[at]
    first = np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]])
    rank = np.empty(len(codes), np.int32)
    rank[at] = np.cumsum(first, dtype=np.int32) - 1
    return codes[first], rank


def counted(codes: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, sorted, and how many of each are learned from; ``codes`` is overwritten."""
    codes <<= np.uint64(1)
    codes |= learned.astype(np.uint64)
    codes.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] >> np.uint64(1) != codes[:-1] >> np.uint64(1)]))
    return codes[first] >> np.uint64(1), np.add.reduceat((codes & np.uint64(1)).astype(np.int64), first)


def word_parts(words: set[bytes], parts: int) -> list[list[bytes]]:
    out: list[list[bytes]] = [[] for _ in range(parts)]
    for word in sorted(words):
        out[zlib.crc32(word) % parts].append(word)
    return out


def gram_parts(grams: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by part, and where each part begins; the order within a part stays."""
    part = ((grams >> np.uint64(8 * (DEPTH - 1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


def block_lists(data: bytes) -> tuple[pa.Table, list[bytes], np.ndarray, list[list[bytes]], set[bytes]]:
    """The rows of a block, its texts, training flags, words of each text and different words."""
    rows = opened_batch(data)
    texts = [(t or "").encode().lower() for t in rows.column("text").to_pylist()]
    words = [t.split() for t in texts]
    return rows, texts, rows.column("learn").to_numpy(), words, set(chain.from_iterable(words))


def items_of(blocks: DataFrame, parts: int) -> DataFrame:
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                _, texts, learn, words, every = block_lists(data)
                known = Counter(chain.from_iterable(w for w, yes in zip(words, learn, strict=True) if yes))
                rows = []
                for part, mine in enumerate(word_parts(every, parts)):
                    if mine:
                        rows.append((WORDS, part, b"\n".join(mine), np.array([known[w] for w in mine], np.int64).tobytes()))
                grams, counts = counted(grams_of(texts), np.repeat(learn, [len(t) + 1 for t in texts]))
                order, cuts = gram_parts(grams, parts)
                for part in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = order[cuts[part] : cuts[part + 1]]
                    rows.append((GRAMS, part, grams[mine].tobytes(), counts[mine].tobytes()))
                kinds, numbers, items, sums = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.int32()), pa.array(numbers, pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array(items, pa.binary()), pa.array(sums, pa.binary())],
                    ["kind", "part", "block", "items", "counts"],
                )

    return blocks.mapInArrow(lists, ITEMS)


# ---- parts

def merged_grams(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The grams of each row, all different grams sorted, and their counts."""
    own = [np.frombuffer(x, np.uint64) for x in rows.column("items").to_pylist()]
    grams, at = np.unique(np.concatenate(own), return_inverse=True)
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist()])
    return own, grams, np.bincount(at, counts, len(grams))


def summary(rows: pa.Table) -> pa.Table:
    """Sums of the part's nodes of depth 2 by their parents."""
    _, grams, counts = merged_grams(rows)
    top = lower_levels(grams, counts)[0]
    node, at = np.unique((top.keys >> 16) * 256 + (top.keys & 255), return_inverse=True)
    sums = [np.bincount(at, x, len(node)) for x in (top.zeros, top.ones, top.weighted)]
    return pa.table({"node": pa.array(node), "zeros": sums[0], "ones": sums[1], "children": sums[2]})


def word_values(rows: pa.Table) -> pa.Table:
    """The whole training count of each word of each block; for block -1 the different words seen and their sum."""
    total: Counter = Counter()
    own = [x.split(b"\n") for x in rows.column("items").to_pylist()]
    for words, counts in zip(own, rows.column("counts").to_pylist(), strict=True):
        for word, n in zip(words, np.frombuffer(counts, np.int64).tolist(), strict=True):
            total[word] += n
    out = [np.fromiter(map(total.__getitem__, words), np.int64, len(words)).tobytes() for words in own]
    out.append(np.array([sum(n > 0 for n in total.values()), sum(total.values())], np.int64).tobytes())
    return _valued(rows, out, [*rows.column("block").to_pylist(), -1])


def _valued(rows: pa.Table, values: list[bytes], blocks: list[int]) -> pa.Table:
    kind, part = rows.column("kind")[0].as_py(), rows.column("part")[0].as_py()
    n = len(values)
    return pa.table(
        {"kind": pa.array([kind] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "block": pa.array(blocks, pa.int64()), "values": pa.array(values, pa.binary())}
    )


def score(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``learn``: which rows are learned from. ``score``: log10 of the probability of the whole text with A-Z
    lowered and of its end; ``base_score``: the same by words with add-one counts, each text with one end.
    Null texts are empty; an empty text is its end alone. Repeated rows count and score as often as they
    stand there. Without any row to learn from all counts are zero. Further columns are left out.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), whole_text(text).alias("text"))
    sums = base.agg(F.sum(F.octet_length("text")), F.sum(F.col("learn").cast("long"))).first()
    ends = int(sums[1] or 0)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, (sums[0] or 0) // BYTES_PER_ITEM // PART_ITEMS)
    blocks = written(blocks_of(base), "blocks")
    items = written(items_of(blocks, parts), "items")

    counted = written(items.where(F.col("kind") == WORDS).groupBy("part").applyInArrow(word_values, VALUES), "counts")
    seen = [np.frombuffer(r["values"], np.int64) for r in counted.where("block = -1").collect()]  # one row a part
    types = sum(int(x[0]) for x in seen) + (ends > 0)
    tokens = sum(int(x[1]) for x in seen) + ends

    grams = items.where(F.col("kind") == GRAMS)
    top = grams.groupBy("part").applyInArrow(summary, "node bigint, zeros double, ones double, children double")
    rows = top.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("children")).collect()
    upper = spark.sparkContext.broadcast(upper_levels(np.array([tuple(r) for r in rows], np.float64).reshape(-1, 4)))

    def gram_values(rows: pa.Table) -> pa.Table:
        own, merged, counts = merged_grams(rows)
        chances = log10_chances(merged, lower_levels(merged, counts), upper.value)
        values = [chances[np.searchsorted(merged, x)].astype(np.float64).tobytes() for x in own]
        return _valued(rows, values, rows.column("block").to_pylist())

    values = counted.where("block >= 0").unionByName(grams.groupBy("part").applyInArrow(gram_values, VALUES))
    schema = T.StructType(
        [T.StructField(doc_id, docs.schema[doc_id].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]
    )

    def scored(block: pa.Table, found: pa.Table) -> pa.Table:
        rows, texts, _, words, every = block_lists(block.column("data")[0].as_py())
        grams, rank = ranked(grams_of(texts))
        chances = np.zeros(len(grams))
        count: dict[bytes, int] = {}
        mine = word_parts(every, parts)
        order, cuts = gram_parts(grams, parts)
        for kind, part, data in zip(*(found.column(n).to_pylist() for n in ("kind", "part", "values")), strict=True):
            if kind == WORDS:
                count.update(zip(mine[part], np.frombuffer(data, np.int64).tolist(), strict=True))
            else:
                chances[order[cuts[part] : cuts[part + 1]]] = np.frombuffer(data, np.float64)
        sizes = [len(t) + 1 for t in texts]
        first = np.cumsum(sizes) - sizes
        total, at = np.zeros(len(texts)), 0
        while at < len(texts):  # some texts at a time
            to = max(at + 1, int(np.searchsorted(first, first[at] + (1 << 20))))
            each = chances[rank[first[at] : first[to - 1] + sizes[to - 1]]]
            total[at:to] = np.add.reduceat(each, first[at:to] - first[at])
            at = to
        known, plain = [], []
        for own in words:
            c = np.fromiter(map(count.__getitem__, own), np.float64, len(own))
            known.append(int((c > 0).sum()) + (ends > 0))
            plain.append(float(np.log10(np.append(c, ends) + 1).sum()) - (len(own) + 1) * np.log10(tokens + types + 1))
        return pa.table(
            [
                rows.column("id").combine_chunks(),
                pa.array([len(w) + 1 for w in words], pa.int64()),
                pa.array(known, pa.int64()),
                pa.array([tokens] * len(words), pa.int64()),
                pa.array(plain, pa.float64()),
                pa.array(total, pa.float64()),
            ],
            names=schema.names,
        )

    return blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(scored, schema)
