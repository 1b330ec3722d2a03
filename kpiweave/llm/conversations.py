"""Repair of the structure of conversations by cheapest edits, ranked by prefix doubling.

A conversation is its rows by turn. Edits keep, rerole or delete a row or insert an empty one such
that the initials of the roles read ``(s?(ua)+)?``. A node is a place between rows and a state of
that pattern; a cost DP from the end gives each node its cheapest way on, and arcs on cheapest ways
are the optimal ones. Nodes are then ranked by the first 1, 2, 4, ... letters of their least audit:
a rank of twice the letters is the rank of a pair, the node's own and that of the node its doubled
pointer reaches. Ranks choose among optimal arcs, and the doubled pointers mark the least path.

Rows are cut by ranges of (conversation, turn, role, text) into parts of bounded size, so one long
conversation is many tasks. Of a conversation in several parts, each part gives its costs from
every state to every state; these small tables are chained from the end, then the states in which
the parts are entered from the start. Texts take part in none of that: they meet their edits once,
in a stream sorted by conversation that holds one batch at a time.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiweave.llm.common import written

#: Rows of a part, about.
PART_ROWS = 250_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANK, DUPLICATE, CUT_SHORT = 1, 2, 3
SPACE = " \t\n\x0b\x0c\r"
LETTERS = "DIKR"
_FAR = 1 << 60
#: States of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a. By initial (s, u, a, other) and state, the next; -1 none.
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: The state after the only role that may follow (by Rerole or Insert).
_NEXT = np.array([2, 2, 3, 2])
#: What each state still costs at the end: up to two inserts.
_END = [0, 2 * INSERT, INSERT, 0]


def initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).cast("int")


def skeleton(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, copy, initial, fault) of ``rows`` (conv, turn, role, text): one row for each, without its text."""
    bare = F.rtrim("text", F.lit(SPACE))
    ended = F.substring(bare, -1, 1).isin(".", "!", "?")
    fault = F.when(bare == "", BLANK).when(ended, 0).otherwise(CUT_SHORT).cast("int")
    thin = rows.select("conv", "turn", "role", F.unhex(F.md5("text")).alias("digest"), fault.alias("fault"))
    several = thin.groupBy("conv", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.min("fault").alias("fault"))
    several = written(several, "said")
    said = several.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("at"))).alias("first"), F.count("*").alias("n"))
    again = said.where("n > 1").select(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("digest").alias("digest_"), "first")
    both = several.join(again, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_")), "left")
    both = both.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.at"))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(later | (F.col("copy") > 0), DUPLICATE).otherwise(F.col("fault"))
    return both.select("conv", "turn", "role", "digest", "copy", initial(F.col("role")).alias("initial"), fault.alias("fault"))


def togo(initials: list[int], faults: list[int], right: list[int]) -> np.ndarray:
    """Cheapest costs from each row's front, by state; ``right`` holds those after the last row and is the last row here."""
    out = [right]
    t0, t1, t2, t3 = right
    for kind, fault in zip(reversed(initials), reversed(faults), strict=True):
        b0, b1, b2, b3 = t0 + DELETE, t1 + DELETE, t2 + DELETE, t3 + DELETE
        if fault != BLANK and fault != DUPLICATE:
            more = TRUNCATED if fault == CUT_SHORT else 0
            user, answer = t2 + REROLE + more, t3 + REROLE + more
            if kind == 1:
                user = t2 + more
            elif kind == 2:
                answer = t3 + more
            b0, b1, b2, b3 = min(b0, user), min(b1, user), min(b2, answer), min(b3, user)
            if kind == 0:
                b0 = min(b0, t1 + more)
        t2, t3 = min(b2, b3 + INSERT), min(b3, b2 + INSERT)
        t0, t1 = min(b0, t2 + INSERT), min(b1, t2 + INSERT)
        out.append((t0, t1, t2, t3))
    return np.array(out[::-1], np.int64)


class Paths:
    """Least audits of the pieces of a part. Piece p has its rows' places and one place more, its end."""

    def __init__(self, initials: np.ndarray, faults: np.ndarray, sizes: list[int], rights: list[list[int] | None]) -> None:
        """``sizes``: rows of each piece; ``rights``: costs from the end of each, None where the conversation ends there."""
        self.first = np.cumsum([0, *[n + 1 for n in sizes]])
        places = int(self.first[-1])
        costs, at = [], 0
        rows = np.ones(places, bool)
        rows[self.first[1:] - 1] = False
        kind, fault = np.full(places, 3), np.zeros(places, np.int64)
        kind[rows], fault[rows] = initials, faults
        for n, right in zip(sizes, rights, strict=True):
            costs.append(togo(initials[at : at + n].tolist(), faults[at : at + n].tolist(), right or _END))
            at += n
        self.cost = cost = np.concatenate(costs)
        last = np.zeros(places, bool)
        last[self.first[1:][[r is None for r in rights]] - 1] = True
        # Arcs by letter, D I K R: target and cost.
        node = np.arange(places * 4).reshape(places, 4)
        below = np.minimum(node + 4, places * 4 - 1)
        free = ((fault != BLANK) & (fault != DUPLICATE) & rows)[:, None]
        more = np.where(fault == CUT_SHORT, TRUNCATED, 0)[:, None]
        kept = _KEPT[kind]
        target = [below, node - np.arange(4) + _NEXT, below - np.arange(4) + kept, below - np.arange(4) + _NEXT]
        allowed = [rows[:, None] | np.zeros(4, bool), ((rows | last)[:, None] & np.ones(4, bool)), free & (kept >= 0), free & np.ones(4, bool)]
        allowed[1] &= ~(last[:, None] & np.array([True, False, False, True]))
        flat = cost.reshape(-1)
        letter, jump = np.zeros(places * 4, np.int64), np.arange(places * 4)
        optimal = []
        for t, a, price in zip(target, allowed, (DELETE, INSERT, KEEP + more, REROLE + more), strict=True):
            t = np.where(a, t, node)
            optimal.append((a & (flat[t] + price == cost)).reshape(-1))
            target[len(optimal) - 1] = t.reshape(-1)
        for code in (4, 3, 2, 1):
            letter = np.where(optimal[code - 1], code, letter)
            jump = np.where(optimal[code - 1], target[code - 1], jump)
        # Ranks of the first letter, then of twice as many letters in each round.
        rank, self.jumps, left = letter.copy(), [jump], (letter > 0).astype(np.int64)
        while (self.jumps[-1] != self.jumps[-1][self.jumps[-1]]).any():
            step = self.jumps[-1]
            _, rank = np.unique(rank * (rank.max() + 1) + rank[step], return_inverse=True)
            left = left + left[step]
            self.jumps.append(step[step])
        # The arc of the least letter, then of the least rank behind it. A node has one arc for each letter, so
        # these are the first round's arcs, and its doubled pointers stay.
        best = np.full(places * 4, _FAR)
        for code in (1, 2, 3, 4):
            key = np.where(optimal[code - 1], code * (places * 4 + 1) + rank[target[code - 1]], _FAR)
            self.jumps[0] = np.where(key < best, target[code - 1], self.jumps[0])
            best = np.minimum(best, key)
        self.letter, self.left = letter, left

    def walk(self, pieces: np.ndarray, state: int) -> tuple[list[str], list[int]]:
        """Audits of the pieces entered in ``state``, and the states in which they are left."""
        start = self.first[pieces] * 4 + state
        marked = np.zeros(len(self.letter), bool)
        marked[start] = True
        for jump in self.jumps:
            marked[jump[np.flatnonzero(marked)]] = True
        on = np.flatnonzero(marked)
        piece = np.searchsorted(self.first, on // 4, side="right") - 1
        on = on[np.lexsort((-self.left[on], piece))]
        piece = np.searchsorted(self.first, on // 4, side="right") - 1
        text = np.frombuffer(b" " + LETTERS.encode(), np.uint8)[self.letter[on]].tobytes()
        cuts = np.searchsorted(piece, np.concatenate([pieces, pieces + 1]))
        audits = [text[a:b].decode().strip() for a, b in zip(cuts[: len(pieces)], cuts[len(pieces) :], strict=True)]
        return audits, (self.jumps[-1][start] % 4).tolist()


def _cuts(column: pa.ChunkedArray | pa.Array) -> list[int]:
    """The starts of runs of equal values, and the end."""
    values = column.to_pylist()
    return [i for i in range(len(values)) if i == 0 or values[i] != values[i - 1]] + [len(values)]


def find_repairs(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(summary, edits) of the conversations of ``rows``.

    Summary, one row for each conversation: ``gaps`` (turns missing between the least and the
    greatest), ``blank``, ``duplicate``, ``truncated`` (rows by first fault), ``illegal`` (adjacent
    initials other than su, ua, au), ``cost``. Edits, in order within a task and by ``place`` in
    all: ``edit`` (K R D I), ``role`` and ``text`` after it; deleted rows keep theirs.

    Null roles and texts count as one space; null turns come first; a null id is a conversation of
    its own. Rows of one turn stand by role and digest of their text, repeated rows side by side.
    Further columns are left out; an empty table gives empty tables.
    """
    spark = rows.sparkSession
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    thin = written(skeleton(base), "skeleton")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-thin.count() // PART_ROWS))
    order = ["conv", "turn", "role", "digest", "copy"]
    cut = thin.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut = written(cut.withColumn("part", F.spark_partition_id().cast("long")).withColumn("at", F.monotonically_increasing_id()), "parts")
    of = T.StructField("conv", base.schema["conv"].dataType)
    fields = lambda *more: T.StructType([of, *(T.StructField(n, k) for n, k in more)])
    number, several = T.LongType(), T.ArrayType(T.LongType())

    # Conversations in more than one part: at most two for each part.
    edges = cut.groupBy("part").agg(F.min(F.struct("conv")).alias("a"), F.max(F.struct("conv")).alias("b"))
    edges = edges.select("part", F.explode(F.array("a", "b")).alias("c")).select("part", "c.conv").distinct()
    long = written(edges.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("long")), "long")

    def through(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        kinds, faults = group.column("initial").to_pylist(), group.column("fault").to_pylist()
        table = [togo(kinds, faults, [0 if q == end else _FAR for q in range(4)])[0].tolist() for end in range(4)]
        flat = [min(_FAR, table[end][q]) for q in range(4) for end in range(4)]
        return pa.table({"conv": group.column("conv").slice(0, 1).combine_chunks(), "part": pa.array([group.column("part")[0].as_py()], pa.int64()), "through": pa.array([flat], pa.list_(pa.int64()))})

    def backwards(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "descending")])
        right, rights = None, []
        for flat in group.column("through").to_pylist():
            rights.append(right)
            after = right or _END
            right = [min(flat[4 * q + e] + after[e] for e in range(4)) for q in range(4)]
        return pa.table({"conv": group.column("conv"), "part": group.column("part"), "right": pa.array(rights, pa.list_(pa.int64()))})

    inside = cut.join(long, F.col("conv").eqNullSafe(F.col("long"))).select("conv", "part", "at", "initial", "fault")
    tables = inside.groupBy("conv", "part").applyInArrow(through, fields(("part", number), ("through", several)))
    ends = written(tables.groupBy("conv").applyInArrow(backwards, fields(("part", number), ("right", several))), "ends")

    counted = ("rows", "cost", "blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "head", "tail", "opens", "closes", "copy")
    kinds = [("part", number), ("across", T.BooleanType()), ("turn", number), ("role", T.StringType()), ("digest", T.BinaryType())]
    schema = fields(*kinds, *((n, number) for n in counted), ("exits", several), ("audits", T.ArrayType(T.StringType())))

    def solve(group: pa.Table, ends: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        starts = _cuts(group.column("conv"))
        sizes = np.diff(starts).tolist()
        known = dict(zip(ends.column("conv").to_pylist(), ends.column("right").to_pylist(), strict=True))
        names = group.column("conv").take(pa.array(starts[:-1])).to_pylist()
        kind, fault = (group.column(n).to_numpy().astype(np.int64) for n in ("initial", "fault"))
        paths = Paths(kind, fault, sizes, [known.get(n) for n in names])
        across = np.array([n in known for n in names])
        audits, exits = [[None] * 4 for _ in names], [[None] * 4 for _ in names]
        for state in range(4):
            chosen = np.flatnonzero(across) if state else np.arange(len(names))
            for p, audit, left in zip(chosen.tolist(), *paths.walk(chosen, state), strict=True):
                audits[p][state], exits[p][state] = audit, left
        turns = group.column("turn").to_pylist()
        rows: dict[str, list] = {n: [] for n in counted}
        for p, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            pairs = {(0, 1), (1, 2), (2, 1)}
            mine, ks, fs = [t for t in turns[a:b] if t is not None], kind[a:b].tolist(), fault[a:b]
            values = (
                b - a, int(paths.cost[paths.first[p], 0]), *(int((fs == x).sum()) for x in (BLANK, DUPLICATE, CUT_SHORT)),
                sum(x not in pairs for x in zip(ks, ks[1:], strict=False)), len(set(mine)), min(mine, default=None), max(mine, default=None),
                mine[0] if mine else None, mine[-1] if mine else None, ks[0], ks[-1], group.column("copy")[a].as_py(),
            )
            for name, value in zip(counted, values, strict=True):
                rows[name].append(value)
        at = pa.array(starts[:-1])
        keys = {n: group.column(n).take(at) for n in ("conv", "turn", "role", "digest")}
        part = pa.array([group.column("part")[0].as_py()] * len(names), pa.int64())
        made = {**keys, "part": part, "across": pa.array(across), **{n: pa.array(v, pa.int64()) for n, v in rows.items()}}
        made |= {"exits": pa.array(exits, pa.list_(pa.int64())), "audits": pa.array(audits, pa.list_(pa.string()))}
        return pa.table({f.name: made[f.name] for f in schema})

    pieces = written(cut.groupBy("part").cogroup(ends.groupBy("part")).applyInArrow(solve, schema), "pieces")

    def forwards(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        state, before, turn, out = 0, None, None, []
        for i, row in enumerate(group.select(["exits", "opens", "closes", "head", "tail"]).to_pylist()):
            bad = int(i > 0 and (before, row["opens"]) not in {(0, 1), (1, 2), (2, 1)})
            out.append((state, bad, int(turn is not None and turn == row["head"]), int(i > 0)))
            state, before, turn = row["exits"][state], row["closes"], turn if row["tail"] is None else row["tail"]
        names = ("state", "bad", "shared", "later")
        return pa.table({"conv": group.column("conv"), "part": group.column("part"), **{n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(names)}})

    some = pieces.where("across").select("conv", "part", "exits", "opens", "closes", "head", "tail")
    entered = some.groupBy("conv").applyInArrow(forwards, fields(("part", number), *((n, number) for n in ("state", "bad", "shared", "later"))))
    entered = entered.withColumnsRenamed({"conv": "conv_", "part": "part_"})
    joined = pieces.join(entered, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_")), "left")
    chosen = written(joined.withColumn("audit", F.element_at("audits", F.coalesce("state", F.lit(0)).cast("int") + 1)).drop("audits", "exits", "conv_", "part_"), "chosen")

    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    turns = F.sum(F.col("turns") - none("shared"))
    summary = chosen.groupBy("conv").agg(
        F.coalesce(F.max("most") - F.min("least") + 1 - turns, F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + none("bad")).alias("illegal"),
        F.sum(F.when(none("later") == 0, F.col("cost"))).alias("cost"),
    )
    return summary.withColumnRenamed("conv", conv), _edits(base, chosen).withColumnRenamed("conv", conv)


def _edits(base: DataFrame, chosen: DataFrame) -> DataFrame:
    """The edits of ``base`` (conv, turn, role, text) by the audits of ``chosen``: rows meet letters in one sorted stream."""
    digest = F.unhex(F.md5("text"))
    said = base.select("conv", "turn", "role", digest.alias("digest"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("copy"), "text")
    letters = chosen.select("conv", "turn", "role", "digest", F.lit(0).alias("kind"), "copy", F.col("audit").alias("text"))
    stream = letters.unionByName(said).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "kind", "copy")
    of = base.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", of), *(T.StructField(n, k) for n, k in (("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())))])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, letters, place, user, started = None, deque(), 0, True, False

        def edit(letter: str, role: str, text: str) -> None:
            nonlocal place, user
            if letter in "RI":
                role = "user" if user else "assistant"
            if letter != "D":
                user = not role.startswith("u")
            out.append((now, place, letter, role, text))
            place += 1

        def close() -> None:
            while started and letters:
                for letter in letters.popleft():
                    edit(letter, "", "")

        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, mark, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "kind", "role", "text")), strict=True):
                if not started or conv != now:
                    close()
                    now, place, user, started = conv, 0, True, True
                    letters.clear()
                if mark == 0:
                    letters.append(iter(text))
                    continue
                while True:  # inserts in front of the row, then the row's own letter
                    letter = next(letters[0], None)
                    if letter is None:
                        letters.popleft()
                        continue
                    edit(letter, role if letter != "I" else "", text if letter != "I" else "")
                    if letter != "I":
                        break
            if out:
                yield _batch(out, schema.names, kind)
                out.clear()
        close()
        if out:
            yield _batch(out, schema.names, kind)

    return stream.select("conv", "kind", "role", "text").mapInArrow(meet, schema)


def _batch(out: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    kinds = [kind if i == 0 else pa.int64() if n == "place" else pa.string() for i, n in enumerate(names)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def digests(edits: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conversation, ``audit``, ``repaired_sha256``) of edits as `find_repairs` returns them, in their order.

    A digest of a text that runs through all rows is one stream; it keeps a batch and the audit.
    """
    schema = T.StructType([T.StructField(conv, edits.schema[conv].dataType), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, total, lines, started, kind, out = None, [], hashlib.sha256(), 0, False, None, []
        for batch in batches:
            kind = batch.schema.field(conv).type
            for name, edit, role, text in zip(*(batch.column(n).to_pylist() for n in (conv, "edit", "role", "text")), strict=True):
                if not started or name != now:
                    if started:
                        out.append((now, "".join(audit), total.hexdigest()))
                    now, audit, total, lines, started = name, [], hashlib.sha256(), 0, True
                audit.append(edit)
                if edit != "D":
                    total.update((("\n" if lines else "") + f"{role}:{text}").encode())
                    lines += 1
            if out:
                yield _batch(out, schema.names, kind)
                out = []
        if started:
            yield _batch([(now, "".join(audit), total.hexdigest())], schema.names, kind)

    return edits.mapInArrow(scan, schema)
