"""Near copies by sketches, against all pairs of full sets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiweave.llm import near_copies, queries, sketch_dedup
from tests.llm.test_exact import plain_groups

SCHEMA = "doc_id bigint, text string"


def run(frame, length=4):
    got = sketch_dedup.find_groups(frame, length=length, least=80).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got)


def some_rows(seed):
    dice, rows = random.Random(seed), []
    for group in range(6):
        words = [f"w{group}x{dice.randint(0, 30)}" for _ in range(dice.choice([4, 9, 12, 40, 150]))]
        for _ in range(40):
            rows.append((len(rows), " ".join(words)))
            for _ in range(dice.randint(0, 2)):
                words[dice.randrange(len(words))] = f"e{dice.randint(0, 9)}"
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "members"), [(1, 4096), (2, 2), (3, 5)])
def test_chains_and_copies(spark, monkeypatch, seed, members):
    monkeypatch.setattr(sketch_dedup, "MEMBERS", members)
    rows = some_rows(seed)
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(4)) == plain_groups(rows, 4, 80)


def test_pairs_held_back_come_in_later_rounds(spark, monkeypatch):
    monkeypatch.setattr(sketch_dedup, "CLOSEST", 1)
    monkeypatch.setattr(sketch_dedup, "GROWTH", 1)
    monkeypatch.setattr(sketch_dedup, "components", lambda links: near_copies.components(links) if rounds.append(1) is None else None)
    rounds, dice = [], random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(f"e{dice.randint(0, 99)}" if dice.random() < 0.02 else w for w in base)) for i in range(60)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == plain_groups(rows, 4, 80) and len(rounds) >= 2


def test_one_id_at_several_texts_and_null_ids(spark):
    """The same groups whatever the order of the rows."""
    words = [f"w{i}" for i in range(60)]
    near = [*words[:-2], "x", "y"]
    far = [f"v{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join(far)), (2, " ".join(near)), (None, " ".join(far[:-1])), (None, " ".join([*far[:-2], "z"])), (None, None), (9, "")]
    rows += [(None, "a b c d e"), (None, "a b c d e")]
    want = plain_groups(rows, 4, 80)
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        assert run(spark.createDataFrame(rows, SCHEMA).repartition(1 + seed)) == want


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    clash = odd_docs.withColumn("node", F.lit(1)).withColumn("said", F.lit("x")).withColumn("component_id", F.lit(7))
    assert run(clash, 3) == plain_groups(rows, 3, 80)
    assert sketch_dedup.find_groups(no_docs).count() == 0
    with pytest.raises(ValueError):
        sketch_dedup.find_groups(no_docs, least=70)


def test_sketches_fill_and_estimate():
    dice = np.random.default_rng(1)
    draw = lambda n: np.unique(dice.integers(0, 2**63, n).astype(np.uint64))
    sets = [draw(n) for n in (1, 2, 3, 30, 500, 20000)]
    found = sketch_dedup.sketches(sets)
    assert (found != np.iinfo(np.uint64).max).all()
    assert all((sketch_dedup.sketches([s])[0] == f).all() for s, f in zip(sets, found, strict=True))
    # Against the definition, by plain loops.
    for s, f in zip(sets[:4], found, strict=False):
        want = {}
        for turn in range(2 * sketch_dedup.COORDS):
            for h in near_copies.mix(s, 100 + turn).tolist():
                place = h >> 57 if turn < sketch_dedup.COORDS else turn - sketch_dedup.COORDS
                value = turn << 55 | h & (1 << 55) - 1
                want[place] = min(want.get(place, value), value)
            if len(want) == sketch_dedup.COORDS:
                break
        assert [want[i] for i in range(sketch_dedup.COORDS)] == f.tolist()
    # Means and spread of agreement keep to the likeness, for short and long sets.
    for size in (9, 90, 900):
        common = [draw(size * 8 // 9) for _ in range(150)]
        pairs = [[np.concatenate([c, draw(size // 9)]) for _ in range(2)] for c in common]
        a, b = (sketch_dedup.sketches([p[i] for p in pairs]) for i in (0, 1))
        equal = (a == b).sum(axis=1)
        assert abs(equal.mean() / 128 - 0.8) < 0.02 and equal.min() > sketch_dedup.AGREEING
        assert ((sketch_dedup.band_keys(a) == sketch_dedup.band_keys(b)).any(axis=1)).all()


def test_the_given_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_sketch_dedup(spark, data).collect()
    assert sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_groups(rows, 4, 80)
