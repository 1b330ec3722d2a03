"""Conversation repair, against a plain search over all edit sequences."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kpiweave.llm import conversations, queries

WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """By (cost, audit) from a best-first search; states of the pattern as text already written."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, made = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            break
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in ("user", "assistant"):
            if role[0] in after[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", at, role[0], (*made, f"{role}:")))
        if at < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, made))
            if faults[at] not in ("blank", "duplicate"):
                more, (_, _, role, text) = int(faults[at] == "truncated"), rows[at]
                if initials[at] in after[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initials[at], (*made, f"{role}:{text}")))
                for role in ("user", "assistant"):
                    if role[0] in after[state]:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, role[0], (*made, f"{role}:{text}")))
    count = lambda f: sum(x == f for x in faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest


def plain_query(rows):
    groups = {r[0]: [] for r in rows}
    for row in plain_damage(rows):
        groups[row[0]].append(row)
    return sorted(((c, *plain_repair(g)) for c, g in groups.items()), key=repr)


def run(spark, rows, monkeypatch):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("conv", F.lit("x")).withColumn("part", F.lit(1)).repartition(5)
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    return sorted((tuple(r) for r in queries.op12_conversations(spark, "").collect()), key=repr)


def some_rows(seed, conversations, most):
    dice = random.Random(seed)
    texts = ["Yes.", "No", "So? ", "", " \t", "Fine!", "Why is that", "Go.\n", None, "é?", "x"]
    rows = []
    for conv in range(conversations):
        for turn in range(dice.randint(1, most)):
            if dice.random() < 0.9:
                role = dice.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "sage"])
                rows.append((conv, turn, role, dice.choice(texts) if dice.random() < 0.5 else f"{turn}-{dice.random()}{dice.choice('.! x')}"))
    return rows


def test_odd_rows_against_a_plain_search(spark, monkeypatch):
    rows = some_rows(1, 150, 9)
    rows += [(None, None, None, None), (None, 3, "user", "Hm."), (None, 3, "user", "Hm."), (990, None, "user", "A."), (990, None, "assistant", "B."), (990, 4, "user", "A.")]
    rows += [(991, t, "user", "Same.") for t in (1, 2, 2, 5)] + [(992, 1, "user", "word " * 30000 + "end."), (992, 2, "assistant", "Ok.")]
    assert run(spark, rows, monkeypatch) == plain_query(rows)


@pytest.mark.parametrize("most", [3, 17])
def test_long_conversations_cross_parts(spark, monkeypatch, most):
    """Parts of a few rows: all conversations are solved in pieces, and no task has more than about a part."""
    monkeypatch.setattr(conversations, "PART_ROWS", most)
    rows = some_rows(2, 4, 120) + [(7, t, "user", "Again.") for t in range(60)] + [(7, 3, "user", "Again.")] * 40
    assert run(spark, rows, monkeypatch) == plain_query(rows)


def test_empty_table(spark, monkeypatch):
    assert run(spark, [], monkeypatch) == []


def test_the_given_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_conversations(spark, data).collect()), key=repr) == plain_query(rows)


def test_ranks_order_audits():
    """Ranks agree with the audits they stand for, from every node."""
    dice = random.Random(4)
    for _ in range(50):
        n = dice.randint(0, 12)
        kinds, faults = ([dice.randint(0, 3) for _ in range(n)] for _ in range(2))
        import numpy as np

        paths = conversations.Paths(np.array(kinds, int), np.array(faults, int), [n], [None])
        for state in range(4):
            (audit,), (end,) = paths.walk(np.array([0]), state)
            cost, at = 0, state
            step = paths.jumps[0]
            letters = []
            while paths.letter[at]:
                letters.append(conversations.LETTERS[paths.letter[at] - 1])
                at = step[at]
            assert audit == "".join(letters) and end == at % 4 and end in (0, 3)
