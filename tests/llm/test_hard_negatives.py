"""Hard negatives against a full comparison."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiweave.llm import hard_negatives, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, dims, every=50, moved=True):
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if moved and i % 7 == 0 else label
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        good.append((i, q + [0] * (dims - len(q)), label))
    out = []
    for at, (i, a, label) in enumerate(good):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j, other) for k, (j, b, other) in enumerate(good) if k != at)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            hits = [(-t, n) for t, n, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, rank, n, -s, t) for rank, (t, n) in enumerate(hits, 1)]
    return sorted(out)


def run(spark, rows, monkeypatch, parts=4):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("chunk", F.lit(1)).withColumn("round", F.lit("x")).withColumn("id", F.lit(2)).repartition(parts)
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    return sorted(tuple(r) for r in queries.op13_hard_negatives(spark, "").collect())


def some_rows(seed, n, dims, spread):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(10, dims))
    rows = []
    for i in range(n):
        label = int(dice.integers(0, 10))
        v = centres[(label + (dice.random() < 0.4)) % 10] + spread * dice.normal(size=dims)
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], label))
    return rows


@pytest.mark.parametrize(("spread", "block", "members"), [(0.2, 64, 3), (1.0, 4096, 256), (5.0, 50, 7)])
def test_against_a_full_comparison(spark, monkeypatch, spread, block, members):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "MEMBERS", members)
    monkeypatch.setattr(hard_negatives, "RUN", 16)
    monkeypatch.setattr(hard_negatives, "ROUND_BYTES", 4000)
    rows = some_rows(1, 700, 8, spread)
    assert run(spark, rows, monkeypatch) == plain(rows, 8)


def test_odd_rows(spark, monkeypatch):
    dice = random.Random(2)
    v = lambda *x: [float(y) for y in x]
    rows = [(0, v(1, 0, 0), 1), (0, v(1, 0, 0), 1), (50, v(0, 0, 0), 2), (100, v(-1, -1, 0), 3), (150, None, 1), (200, [1.0, None, 0.0], 1), (250, [float("nan"), 0.0, 0.0], 1),
            (300, [float("inf"), 0.0, 0.0], 1), (350, v(1, 1, 1), None), (None, v(1, 0, 0), 1), (400, [], 2), (450, v(1), 1), (500, v(40, -30, 2), 4)]
    rows += [(i, v(*(dice.choice([0, 0.5, 0.6, 0.7, 1]) for _ in range(3))), dice.randint(0, 4)) for i in range(1, 300) if i % 50]
    rows += [(1000 + i, v(0.7, 0.7, 0), i % 2) for i in range(200)]
    assert run(spark, rows, monkeypatch) == plain(rows, 3)
    assert run(spark, [], monkeypatch) == [] and run(spark, [(1, [1.0], 1)], monkeypatch) == []


def test_the_given_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, data).collect()) == plain(rows, 64)


def test_walks_end_early():
    """On clustered vectors most of a block stays unscored once lists are full."""
    rows = some_rows(3, 4000, 16, 0.05)
    x = np.floor(256 * np.array([r[1] for r in rows]))
    ids, labels = np.arange(4000), np.array([r[2] for r in rows])
    pick = np.flatnonzero((labels == 3) & (ids % 7 == 0))[:20]
    row = {"n": len(pick), "rows": ids[pick].tobytes(), "labels": labels[pick].tobytes(), "vectors": x[pick].astype(np.int64).tobytes()}
    chunk = hard_negatives.Chunk(row, 16, hard_negatives.Negatives(), True)
    lists = hard_negatives.Lists(len(pick), 5, chunk.floor)
    assert hard_negatives.walk(chunk, {"x": x, "ids": ids, "labels": labels, "rows": ids}, lists) < 2000
