"""Hard negatives by shared lists of anchor clusters, exact.

Anchors are clustered by direction. For a chunk of a cluster (a centre and the greatest angle of a
member to it) the rows of a block are sorted once by a bound on the inner product that any member
of unit length can have with them: length times the cosine of their angle to the centre, less that
greatest angle. Every member walks this shared list from its head, scoring runs of rows with all
members that are not yet done; a member is done when the bound of the next row, times its own
length, is below the least score that could still enter its result. Bounds carry a margin for
rounding and scores are integers, so the results are those of a full comparison.

Rows are packed into blocks once. Chunks of anchors go to the blocks in rounds of bounded bytes, so
the rows themselves are never shuffled; a task keeps its anchors' lists from block to block, which
lets later blocks end sooner, and hands on a few rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiweave.llm.common import written

#: Rows of a block; anchors of a chunk; rows scored at a time; bytes of anchors that a round broadcasts.
BLOCK_ROWS, MEMBERS, RUN, ROUND_BYTES = 4096, 256, 512, 16 << 20
#: Anchors (by hash of their ids) that the centres are fitted on, and centres at most.
FITTED, CENTRES = 4096, 64
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Negatives:
    """Which rows are anchors and what counts as a hard negative."""

    every: int = 50
    positives: int = 5
    negatives: int = 3
    #: least and most: percentages of the positive's score.
    least: int = 50
    most: int = 95


def _packed(rows: DataFrame, dims: int) -> DataFrame:
    """Blocks of rows (id, label, vector): numbers of the rows, ids, labels and integer components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, len(whole), BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                vectors, n = batch.column("vector"), len(batch)
                lengths = pa.compute.list_value_length(vectors).to_numpy()
                values = np.floor(256 * pa.compute.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64))
                if len(values) and np.abs(values).max() >= 2.0**62:
                    raise ValueError("a component is too large for an integer score")
                full = np.zeros((n, dims), np.int64)
                full[np.repeat(np.arange(n), lengths), np.concatenate([np.arange(k) for k in lengths]) if n else []] = values.astype(np.int64)
                ids, labels = (batch.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
                columns = [[n], [np.arange(number, number + n).tobytes()], [ids.tobytes()], [labels.tobytes()], [full.astype(np.min_scalar_type(-1 - int(np.abs(full).max(initial=0)))).tobytes()]]
                number += n
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *[pa.binary()] * 4), strict=True)], ["n", "rows", "ids", "labels", "vectors"])

    return rows.mapInArrow(pack, "n bigint, rows binary, ids binary, labels binary, vectors binary")


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _matrix(data: bytes, n: int, dims: int) -> np.ndarray:
    """Components of n vectors; their width follows from the bytes."""
    if not dims:
        return np.zeros((n, 0))
    return np.frombuffer(data, f"<i{len(data) // (n * dims)}").reshape(n, dims).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-300)


def fitted_centres(vectors: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Directions of clusters of the given vectors (spherical k-means); bounded by FITTED and CENTRES."""
    unit = _unit(vectors)
    centres = unit[:: max(1, len(unit) // min(CENTRES, max(1, int(len(unit) ** 0.5))))][:CENTRES]
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        centres = np.where((np.abs(sums).sum(axis=1) > 0)[:, None], _unit(sums), centres)
    return centres


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where no partial sum can leave their exact range."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("a score does not fit 64 bits")


class Lists:
    """The best entries of each slot: an anchor, or an anchor and one of its positives."""

    def __init__(self, slots: int, most: int, floor: np.ndarray) -> None:
        self.slots, self.most, self.floor = slots, most, floor
        self.slot, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.least, self.last = floor.copy(), np.full(slots, np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.most
        full = place == self.most - 1
        self.least[slot[full]], self.last[slot[full]] = score[full], ids[full]
        self.slot, self.score, self.ids = slot[kept], score[kept], ids[kept]


def walk(chunk: Chunk, block: dict, lists: Lists) -> int:
    """All slots of a chunk walk a block's shared list until each is done; returns the rows scored."""
    x, ids, labels, rows = block["x"], block["ids"], block["labels"], block["rows"]
    length = np.sqrt((x * x).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        angle = np.where(length > 0, np.arccos(np.clip((x @ chunk.centre) / length, -1, 1)), 0)
    bound = length * np.cos(np.maximum(0, angle - chunk.spread))
    order = np.lexsort((ids, -bound))
    # Margins: rounding of angles (1e-7) and of the bound, well above what doubles lose.
    margin = (length.max(initial=0) * 1e-6) + 1e-6
    active, at = np.arange(lists.slots), 0
    while at < len(order):
        active = active[chunk.length[chunk.member[active]] * (bound[order[at]] + margin) + 1e-3 >= lists.least[active]]
        if not len(active):
            break
        run = order[at : at + RUN]
        at += RUN
        members, inverse = np.unique(chunk.member[active], return_inverse=True)
        score = exact_scores(chunk.x[members], x[run])
        same = chunk.labels[members][:, None] == labels[run]
        other = chunk.rows[members][:, None] != rows[run]
        fits = (same & other) if chunk.same else (~same & other)
        score = np.where(fits, score, _NONE)[inverse]
        good = (score >= lists.least[active][:, None]) & (score <= chunk.ceiling[active][:, None]) & (score != _NONE)
        i, j = np.nonzero(good)
        slot, found, names = active[i], score[i, j], ids[run][j]
        enters = (found > lists.least[slot]) | (names < lists.last[slot])
        if enters.any():
            lists.add(slot[enters], found[enters], names[enters])
    return min(at, len(order))


class Chunk:
    """Anchors of one cluster with their slots."""

    def __init__(self, row: dict, dims: int, rule: Negatives, same: bool) -> None:
        n = row["n"]
        self.same, self.rows, self.labels = same, _numbers(row["rows"]), _numbers(row["labels"])
        self.x = _matrix(row["vectors"], n, dims)
        self.length = np.sqrt((self.x * self.x).sum(axis=1))
        unit = _unit(self.x)
        self.centre = _unit(unit.sum(axis=0))
        cosine = np.clip(unit @ self.centre, -1, 1)
        # An anchor of length 0 scores 0 with all rows: no angle bounds that.
        self.spread = np.pi if (self.length == 0).any() else float(np.arccos(cosine.min(initial=1))) + 1e-7
        if same:
            self.member = np.arange(n)
            self.floor, self.ceiling = np.full(n, _NONE + 1), np.full(n, np.iinfo(np.int64).max)
        else:
            self.member, scores = _numbers(row["member"]), _numbers(row["scores"])
            self.floor, self.ceiling = -(-rule.least * scores // 100), rule.most * scores // 100


def _found(blocks: DataFrame, chunks: DataFrame, rounds: int, dims: int, rule: Negatives, same: bool) -> DataFrame:
    """(chunk, slot, score, id) of the best rows by task, all rounds."""
    most = rule.positives if same else rule.negatives

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, Lists] = {}
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk({k[2:]: v for k, v in row.items() if k.startswith("c_")}, dims, rule, same)
                block = {"x": _matrix(row["vectors"], row["n"], dims), **{k: _numbers(row[k]) for k in ("ids", "labels", "rows")}}
                lists = state.setdefault(row["chunk"], Lists(len(chunk.member), most, chunk.floor))
                walk(chunk, block, lists)
        for name, lists in state.items():
            columns = (np.full(len(lists.slot), name), lists.slot, lists.score, lists.ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["chunk", "slot", "score", "id"])

    out = None
    for turn in range(rounds):
        now = F.broadcast(chunks.where(F.col("round") == turn))
        found = blocks.withColumn("round", F.lit(turn).cast("long")).join(now, "round").drop("round").mapInArrow(scan, "chunk bigint, slot bigint, score bigint, id bigint")
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("chunk", "slot").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def mine(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rule: Negatives = Negatives()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Rows without id, label or vector, or with a null or non-finite component, take no part. A shorter
    vector counts as filled up with zeros. Repeated rows stand each for itself: an anchor's repeated
    row is another row. Ties go to the smaller id. Further columns are left out; an empty table
    gives an empty table. A score beyond 64 bits is an error.
    """
    spark = rows.sparkSession
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    base = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", real))
    dims = base.agg(F.max(F.size("vector"))).first()[0] or 0
    blocks = written(_packed(base, dims), "blocks")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _numbers(row["ids"])
                at = np.flatnonzero(ids % rule.every == 0)
                x = _matrix(row["vectors"], row["n"], dims)[at].astype(np.int64)
                columns = [pa.array(_numbers(row[k])[at]) for k in ("rows", "ids", "labels")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in x], pa.binary())], ["row", "id", "label", "vector"])

    anchors = blocks.mapInArrow(pick, "row bigint, id bigint, label bigint, vector binary")
    sample = anchors.orderBy(F.xxhash64("id"), "row").limit(FITTED).select("vector").toArrow().column("vector").to_pylist()
    centres = fitted_centres(_matrix(b"".join(sample), len(sample), dims)) if sample else np.zeros((1, dims))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(b"".join(batch.column("vector").to_pylist()), len(batch), dims)
            nearest = (_unit(x) @ centres.T).argmax(axis=1).astype(np.int64)
            yield batch.append_column("cluster", pa.array(nearest))

    named = written(anchors.mapInArrow(assign, "row bigint, id bigint, label bigint, vector binary, cluster bigint"), "anchors")
    # Clusters are cut into chunks; the table of clusters is bounded by CENTRES.
    sizes = {r["cluster"]: r["count"] for r in named.groupBy("cluster").count().collect()}
    first, total = {}, 0
    for cluster in sorted(sizes):
        first[cluster] = (total, -(-sizes[cluster] // MEMBERS))
        total += first[cluster][1]
    if not total:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    places = spark.createDataFrame([(c, a, n) for c, (a, n) in first.items()], "cluster bigint, base bigint, cuts bigint")
    placed = named.join(places, "cluster").withColumn("chunk", F.col("base") + F.pmod(F.xxhash64("row"), F.col("cuts"))).drop("base", "cuts", "cluster")
    placed = written(placed, "placed")
    rounds = max(1, -(-total * MEMBERS * 8 * (dims + 4 + 2 * rule.positives) // ROUND_BYTES))

    def chunked(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        x = np.frombuffer(b"".join(group.column("vector").to_pylist()), np.int64)
        chunk = group.column("chunk")[0].as_py()
        made = {
            "chunk": pa.array([chunk]), "round": pa.array([chunk % rounds]), "c_n": pa.array([len(group)]),
            "c_rows": pa.array([group.column("row").to_numpy().tobytes()]), "c_labels": pa.array([group.column("label").to_numpy().tobytes()]),
            "c_vectors": pa.array([x.tobytes()], pa.binary()),
        }
        if "scores" in group.column_names:
            scores = group.column("scores").to_pylist()
            made["c_member"] = pa.array([np.repeat(np.arange(len(scores)), [len(s) for s in scores]).tobytes()])
            made["c_scores"] = pa.array([np.array([v for s in scores for v in s], np.int64).tobytes()])
        return pa.table(made)

    kinds = "chunk bigint, round bigint, c_n bigint, c_rows binary, c_labels binary, c_vectors binary"
    chunks = written(placed.groupBy("chunk").applyInArrow(chunked, kinds), "chunks")
    positives = written(_found(blocks, chunks, rounds, dims, rule, True).withColumnRenamed("id", "positive_id"), "positives")

    # An anchor's slot in pass one is its place in the chunk by row; in pass two slots count positives by anchor and rank.
    place = F.row_number().over(Window.partitionBy("chunk").orderBy("row")) - 1
    members = placed.withColumn("slot", place.cast("long"))
    pairs = members.join(positives, ["chunk", "slot"]).select("chunk", "row", F.col("id").alias("anchor_id"), "positive_id", F.col("score").alias("positive_score"), F.col("rank").alias("nth"))
    pair = F.row_number().over(Window.partitionBy("chunk").orderBy("row", "nth")) - 1
    pairs = written(pairs.withColumn("slot", pair.cast("long")), "pairs")
    scores = pairs.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    again = placed.join(scores, "row").groupBy("chunk").applyInArrow(chunked, kinds + ", c_member binary, c_scores binary")
    negatives = _found(blocks, written(again, "chunks"), rounds, dims, rule, False).withColumnRenamed("id", "negative_id")
    return pairs.join(negatives, ["chunk", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))
