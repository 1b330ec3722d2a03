"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. Filters of WIDTH bytes (one learned
weight for each place and byte value) run over each chunk in steps of STEP and are max-pooled;
the means and maxima of the pooled values over all chunks make one logit. Training follows the
gradient by Adam over a bounded sample of labelled texts on the driver: through a maximum only
the winning place gets a gradient, so a step touches few weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiweave.llm.common import slices, whole_text

CHUNK, STRIDE, WIDTH, STEP, FILTERS = 512, 448, 8, 2, 24
#: Labelled texts that are learned from, for each label, and the bytes that one of them may have.
SAMPLE_TEXTS, SAMPLE_BYTES = 1000, 64 << 10
ROUNDS, BATCH, RATE = 8, 32, 0.01
RUN_BYTES = 1 << 20
PLACES = STEP * np.arange((CHUNK - WIDTH) // STEP + 1)


@dataclass
class Network:
    """``filters[place, byte, filter]``, a bias for each filter, and weights of [mean, max, 1]."""

    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks (rows of CHUNK bytes, zeros behind the end) and the text of each."""
    count = np.array([1 + max(0, -(-(len(t) - CHUNK) // STRIDE)) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), count)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    sizes = np.array([len(t) for t in texts], np.int64)
    base = (np.cumsum(sizes) - sizes)[owner] + rank * STRIDE
    data = np.frombuffer(b"".join(texts) + bytes(CHUNK), np.uint8)
    at = np.minimum(base[:, None] + np.arange(CHUNK), len(data) - 1)
    inside = rank[:, None] * STRIDE + np.arange(CHUNK) < sizes[owner][:, None]
    return data[at] * inside, owner


def pooled(net: Network, chunks: np.ndarray, winners: bool = False):
    """The largest response of each filter in each chunk, never below 0, and where it is."""
    peaks, where = [], []
    for part in np.array_split(chunks, max(1, len(chunks) // 64)):
        total = np.take(net.filters[0], part[:, PLACES], axis=0)
        for k in range(1, WIDTH):
            total += np.take(net.filters[k], part[:, PLACES + k], axis=0)
        if winners:
            where.append(total.argmax(axis=1))
        peaks.append(total.max(axis=1))
    peaks = np.maximum(np.concatenate(peaks) + net.bias, 0)
    return (peaks, np.concatenate(where)) if winners else peaks


def combined(peaks: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """[means, maxima, 1] over the chunks of each text; chunks of a text stand together."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(first, len(owner)))[:, None]
    mean = np.add.reduceat(peaks, first, axis=0) / count
    return np.hstack([mean, np.maximum.reduceat(peaks, first, axis=0), np.ones_like(mean[:, :1])])


def probability(net: Network, texts: list[bytes]) -> np.ndarray:
    chunks, owner = chunked(texts)
    logit = combined(pooled(net, chunks), owner) @ net.out
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> Network:
    """A network for labels 0 and 1; the same texts in the same order give the same network."""
    random = np.random.default_rng(7)
    net = Network(
        random.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        random.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32),
    )
    params = [net.filters, net.bias, net.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    steps = 0
    for _ in range(ROUNDS):
        order = random.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            chunks, owner = chunked([texts[i] for i in pick])
            peaks, where = pooled(net, chunks, winners=True)
            features = combined(peaks, owner)
            p = 1 / (1 + np.exp(-np.clip(features @ net.out, -30, 30)))
            slope = ((p - labels[pick]) * weights[pick] / len(pick)).astype(np.float32)
            g_out = features.T @ slope
            count = np.bincount(owner)[owner][:, None]
            is_top = peaks == features[owner, FILTERS : 2 * FILTERS]
            g_peak = slope[owner][:, None] * (net.out[:FILTERS] / count + net.out[FILTERS : 2 * FILTERS] * is_top)
            g_peak[peaks <= 0] = 0
            g_filters = np.zeros_like(net.filters)
            rows = np.arange(len(chunks))[:, None]
            for k in range(WIDTH):
                np.add.at(g_filters[k], (chunks[rows, STEP * where + k], np.arange(FILTERS)[None, :]), g_peak)
            steps += 1
            for param, grad, m, v in zip(params, [g_filters, g_peak.sum(axis=0), g_out], first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return net


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Network | None:
    """A network from at most SAMPLE_TEXTS texts of each label (those with the least hashes of the id).

    Rows without id or label are left out, as are texts beyond SAMPLE_BYTES; with one label only
    there is nothing to learn, and the answer is None. Texts weigh as their label's share of all labels.
    """
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    share = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    chosen = marked.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_TEXTS).select("id", "y").distinct()
    ids = chosen.collect()
    whole = docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES)
    texts = {r["id"]: r["t"].encode() for r in whole.where(F.col("id").isin([r["id"] for r in ids])).distinct().collect()}
    rows = [(texts[r["id"]], r["y"]) for r in sorted(ids) if r["id"] in texts]
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    have = np.bincount(y.astype(int), minlength=2)
    weights = np.array([share[k] / have[k] for k in (0, 1)])
    return train([r[0] for r in rows], y, (weights * len(y) / (weights * have).sum())[y.astype(int)].astype(np.float32))


def score(docs: DataFrame, net: Network | None, text: str = "text", result: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text.

    Null counts as the empty text, which is one chunk of zeros. Without a network all scores are
    0.5. Repeated rows score alike; further columns stay, one named as the result is replaced.
    """

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [np.full(len(batch), 0.5)] if net is None else [
                probability(net, [t or b"" for t in run.to_pylist()]) for run in slices(batch, RUN_BYTES)
            ]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return docs.withColumn(result, scored(whole_text(text)))
