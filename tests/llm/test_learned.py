"""Classifier, languages and scores against held-out rows and plain versions."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiweave.llm import context_tree, languages, quality, queries
from tests.llm.conftest import LINES, fold


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op1_quality(spark, folder).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.85


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    net = quality.learn(odd_docs, labels)
    got = quality.score(odd_docs, net).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["text"] == LINES[0]}) == 1
    assert quality.learn(odd_docs, labels.where("quality = 1")) is None
    assert {r["score"] for r in quality.score(odd_docs, None).collect()} == {0.5}
    assert quality.score(no_docs, net).count() == 0


def test_chunks_cover_the_text():
    text = bytes(range(1, 251)) * 9
    chunks, owner = quality.chunked([text, b"", b"ab"])
    assert owner.tolist() == [0] * (len(chunks) - 2) + [1, 2]
    again = b"".join(bytes(c[: quality.STRIDE]) for c in chunks[:-3]) + bytes(chunks[-3])
    assert again.rstrip(b"\0") == text


def greedy(text: bytes, sample: bytes) -> int:
    at = n = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def test_phrases_are_the_longest_matches():
    samples = tuple((n, languages.symbols(t)) for n, t in zip(("en", "es", "de"), LINES, strict=True))
    parser = languages.Parser(samples)
    texts = [languages.symbols(t) for t in [*LINES, "", "zzz", "the house and the perro über alles", "a" * 5000]]
    want = [[sum(greedy(t[i : i + languages.BLOCK], s) for i in range(0, len(t), languages.BLOCK)) for _, s in samples] for t in texts]
    assert parser.phrases(texts).tolist() == want


def test_languages_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in queries.op2_languages(spark, folder).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_languages_of_odd_rows(odd_docs, no_docs):
    learn = odd_docs.withColumn("lang", F.when(F.col("doc_id") == 6, "es").when(F.col("doc_id") == 4, "en"))
    got = languages.identify(odd_docs, learn).collect()
    assert len(got) == odd_docs.count()
    for row in got:
        letters = any(map(str.isalpha, row["text"] or ""))
        assert (row["language"]["lang_pred"] == "und") == (not letters)
        if row["text"] == LINES[1]:
            assert row["language"]["lang_pred"] == "es"
    nothing = languages.identify(odd_docs, no_docs).collect()
    assert {r["language"]["lang_pred"] for r in nothing} == {"und"}
    assert languages.identify(no_docs, no_docs).count() == 0


def plain_tree(train: list[bytes], depth: int):
    """Recursive context-tree weighting, node by node."""
    counts = collections.defaultdict(lambda: [0, 0])

    def steps(text):
        padded = bytes(depth) + text + b"\xff"
        for i in range(depth, len(padded)):
            for k in range(8):
                yield padded, i, 1 << k | padded[i] >> (8 - k), padded[i] >> (7 - k) & 1

    for text in train:
        for s, i, node, bit in steps(text):
            for d in range(depth + 1):
                counts[s[i - d : i], node][bit] += 1
    below = collections.defaultdict(list)
    for context, node in list(counts):
        if context:
            below[context[1:], node].append((context, node))

    def estimate(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    known = {}

    def weighted(n):
        if n not in known:
            known[n] = estimate(*counts[n])
            if len(n[0]) < depth:
                known[n] = math.log(0.5) + float(np.logaddexp(known[n], sum(map(weighted, below[n]))))
        return known[n]

    def score(text):
        total = 0.0
        for s, i, node, bit in steps(text):
            p = None
            for d in range(depth, -1, -1):
                n = (s[i - d : i], node)
                a, b = counts[n] if n in counts else (0, 0)
                own = (b + 0.5) / (a + b + 1)
                if p is None:
                    p = own
                else:
                    stay = math.exp(math.log(0.5) + estimate(a, b) - (weighted(n) if n in counts else 0))
                    p = stay * own + (1 - stay) * p
            total += math.log10(p if bit else 1 - p)
        return total

    return score


def test_scores_against_a_plain_tree(odd_docs, no_docs):
    docs = odd_docs.where("doc_id is null or doc_id <> 10")
    learn = F.col("doc_id") % 2 == 0
    got = context_tree.score(docs, learn).collect()
    rows = [(r["doc_id"], (r["text"] or "").encode().lower()) for r in docs.collect()]
    train = [t for i, t in rows if i is not None and i % 2 == 0]
    score = plain_tree(train, context_tree.DEPTH)
    words = collections.Counter(w for t in train for w in [*t.split(), b""])
    n, v = sum(words.values()), len(words)
    want = sorted(
        (i is None, i or 0, len(t.split()) + 1, sum(words[w] > 0 for w in [*t.split(), b""]), n,
         round(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in [*t.split(), b""]), 6), round(score(t), 6))
        for i, t in rows
    )
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[k] for k in ("n_tokens", "n_known", "train_tokens")], round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    assert have == want
    assert context_tree.score(no_docs, learn).count() == 0
    untrained = context_tree.score(docs.where("doc_id = 0"), F.lit(False)).collect()
    assert untrained[0]["score"] == 8 * math.log10(0.5) and untrained[0]["n_known"] == 0


@pytest.mark.parametrize("bits", [23, 3])
def test_grams_are_sorted_once(monkeypatch, bits):
    """Ranks and training counts of a block come from one sort each, also where places need more bits than are left."""
    monkeypatch.setattr(context_tree, "PLACE_BITS", bits)
    dice = np.random.default_rng(bits)
    for n in (1, 2, 8, 9, 1000):
        codes = dice.integers(0, 1 << 40, max(1, n // 3)).astype(np.uint64)[dice.integers(0, max(1, n // 3), n)]
        learned = dice.random(n) < 0.5
        want, rank = np.unique(codes, return_inverse=True)
        grams, counts = context_tree.counted(codes.copy(), learned)
        assert grams.tolist() == want.tolist() and counts.tolist() == np.bincount(rank, learned, len(want)).tolist()
        grams, found = context_tree.ranked(codes.copy())
        assert grams.tolist() == want.tolist() and found.tolist() == rank.tolist()
