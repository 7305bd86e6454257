"""Quality classifier: a byte-level convolutional network, written and trained in numpy.

A document's UTF-8 bytes are cut into chunks that overlap by a filter's width less one, so every window of bytes lies
in a chunk. Learned filters run over each chunk; a filter's response to a chunk is its maximum there. The document is
the mean, the maximum and the minimum over its chunks of those responses: a layer and a logistic unit make one
probability of them. No byte is left out, however long the text, and memory is bounded by the chunk.

Training takes place on the driver, on a bounded sample of labelled rows (``MAX_TRAIN_ROWS`` rows; of a text longer
than ``MAX_TRAIN_BYTES``, pieces spread over all of it; classes in equal parts, the natural share of classes restored
by weights). Scoring is
a map over all rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import drop, text_or_empty, written

WIDTH = 6
FILTERS = 24
CHUNK = 512
MAX_TRAIN_ROWS = 1600
MAX_TRAIN_BYTES = 16_384
#: Pieces, of as many characters as a chunk has bytes, that a longer text is learned from.
SPREAD = 32
EPOCHS = 12
SEED = 7
#: Chunks that are convolved at a time.
_CHUNKS_AT_ONCE = 64


def chunks_of(data: bytes) -> np.ndarray:
    """(n, CHUNK) bytes plus 1, zero where there is none; neighbours share WIDTH - 1 bytes. An empty text is one chunk."""
    step = CHUNK - WIDTH + 1
    n = max(1, -(-max(0, len(data) - WIDTH + 1) // step))
    flat = np.zeros((n - 1) * step + CHUNK, dtype=np.int16)
    flat[: len(data)] = np.frombuffer(data, dtype=np.uint8).astype(np.int16) + 1
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


@dataclass
class ByteCnn:
    """``taps[j, byte, f]``: what byte ``byte`` at place ``j`` of a window adds to filter ``f``."""

    taps: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: float

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> ByteCnn:
        taps = rng.normal(0, 0.5 / np.sqrt(WIDTH), (WIDTH, 257, FILTERS)).astype(np.float32)
        taps[:, 0] = 0
        return cls(taps, np.zeros(FILTERS, dtype=np.float32), rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), 0.0)

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, FILTERS) maxima of the filters over each chunk, and where they are."""
        span = CHUNK - WIDTH + 1
        tops, places = [], []
        for i in range(0, len(chunks), _CHUNKS_AT_ONCE):
            part = chunks[i : i + _CHUNKS_AT_ONCE]
            total = np.take(self.taps[0], part[:, :span], axis=0)
            for j in range(1, WIDTH):
                total += np.take(self.taps[j], part[:, j : j + span], axis=0)
            at = total.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0] + self.bias)
        return np.concatenate(tops), np.concatenate(places)

    def tops(self, chunks: np.ndarray) -> np.ndarray:
        """The maxima alone."""
        span = CHUNK - WIDTH + 1
        out = []
        for i in range(0, len(chunks), _CHUNKS_AT_ONCE):
            part = chunks[i : i + _CHUNKS_AT_ONCE]
            total = np.take(self.taps[0], part[:, :span], axis=0)
            for j in range(1, WIDTH):
                total += np.take(self.taps[j], part[:, j : j + span], axis=0)
            out.append(total.max(axis=1) + self.bias)
        return np.concatenate(out)

    def pooled(self, tops: np.ndarray) -> np.ndarray:
        t = np.tanh(tops)
        return np.concatenate([t.mean(0), t.max(0), t.min(0)])

    def probability(self, pooled: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(float(pooled @ self.head) + self.offset, -30, 30))))

    def score(self, text: str) -> float:
        """The probability of label 1; defined for empty texts too."""
        data, best = text.encode(), None
        step = (CHUNK - WIDTH + 1) * _CHUNKS_AT_ONCE
        n, total, high, low = 0, 0.0, None, None
        for start in range(0, max(1, len(data) - WIDTH + 1), step):
            best = np.tanh(self.tops(chunks_of(data[start : start + step + WIDTH - 1])))
            n += len(best)
            total = total + best.sum(0, dtype=np.float64)
            high = best.max(0) if high is None else np.maximum(high, best.max(0))
            low = best.min(0) if low is None else np.minimum(low, best.min(0))
        return self.probability(np.concatenate([(total / n).astype(np.float32), high, low]))


def fit(texts: list[str], labels: list[int], weights: list[float] | None = None, epochs: int = EPOCHS, seed: int = SEED) -> ByteCnn:
    """Train by Adam on the weighted log loss; the gradient of a maximum goes to its place. Without both classes the
    network answers the share of label 1 (0.5 for no rows)."""
    rng = np.random.default_rng(seed)
    net = ByteCnn.fresh(rng)
    y = np.array(labels, dtype=np.float64)
    w = np.ones(len(y)) if weights is None else np.array(weights, dtype=np.float64)
    if len(set(labels)) < 2:
        share = y.mean() if len(y) else 0.5
        net.head[:] = 0
        net.offset = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    w /= w.mean()
    docs = [chunks_of(t.encode()) for t in texts]
    params = [net.taps, net.bias, net.head, np.array([net.offset], dtype=np.float32)]
    share = float((w * y).sum() / w.sum())
    params[3][0] = np.log(share / (1 - share))
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        rate = 0.02 * (1 - 0.8 * epoch / epochs)
        for i in range(0, len(order), 16):
            batch = order[i : i + 16]
            grads = [np.zeros_like(p) for p in params]
            stacked = np.concatenate([docs[d] for d in batch])
            tops, places = net.responses(stacked)
            at = 0
            for d in batch:
                n = len(docs[d])
                t = np.tanh(tops[at : at + n])
                pool = np.concatenate([t.mean(0), t.max(0), t.min(0)])
                z = float(pool @ params[2]) + float(params[3][0])
                err = w[d] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[d]) / len(batch)
                grads[2] += err * pool
                grads[3] += err
                g = np.repeat(err * params[2][None, :FILTERS] / n, n, axis=0)
                cols = np.arange(FILTERS)
                g[t.argmax(0), cols] += err * params[2][FILTERS : 2 * FILTERS]
                g[t.argmin(0), cols] += err * params[2][2 * FILTERS :]
                g *= 1 - t * t
                grads[1] += g.sum(0)
                for j in range(WIDTH):
                    what = np.take_along_axis(docs[d], places[at : at + n] + j, axis=1)
                    np.add.at(grads[0][j], (what, np.broadcast_to(cols, what.shape)), g)
                at += n
            grads[0][:, 0] = 0
            grads[2] += 1e-4 * params[2]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.offset = float(params[3][0])
    return net


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = MAX_TRAIN_ROWS) -> list[tuple[str, int, float]]:
    """At most ``max_rows`` (text, label, weight), half of them of each class if there are as many, in the order of a
    hash of the id. Only labels whose document is in ``docs`` count: the sample is taken from them, and the weight
    restores each class's share of them. Of a longer text than MAX_TRAIN_BYTES, SPREAD pieces at equal distances from
    its beginning to its end stand for it. Of rows that repeat an id the least text counts, of labels the least."""
    half = max_rows // 2
    known = labels.select(F.col(labels.columns[0]).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"))
    text = text_or_empty(F.col(text_col))
    step = (F.length(text) - CHUNK) / (SPREAD - 1)
    pieces = F.concat(*(F.substring(text, F.floor(step * k).cast("int") + 1, F.lit(CHUNK)) for k in range(SPREAD)))
    rows = docs.select(F.col(id_col).alias("_d"), F.when(F.octet_length(text) <= MAX_TRAIN_BYTES, text).otherwise(pieces).alias("_text")).where("_d is not null")
    known = written(known.join(rows.select("_d").distinct(), F.col("_d") == F.col("_id")).select("_id", "_y"), "labelled")
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if len(counts) == 1:
        warnings.warn(f"all labelled documents have label {min(counts)}: every document gets one score", stacklevel=2)
    picked = [r for y in (0, 1) for r in known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(half).collect()]
    schema = known.schema
    drop(known)
    if not picked:
        return []
    chosen = docs.sparkSession.createDataFrame(picked, schema)  # at most max_rows
    found = rows.join(F.broadcast(chosen), F.col("_d") == F.col("_id")).groupBy("_id", "_y").agg(F.min("_text").alias("_text")).collect()
    number = {y: sum(r["_y"] == y for r in found) for y in (0, 1)}
    return [(r["_text"], r["_y"], counts[r["_y"]] / number[r["_y"]]) for r in sorted(found, key=lambda r: r["_id"])]


def with_score(docs: DataFrame, net: ByteCnn, text_col: str, name: str) -> DataFrame:
    """``docs`` with the network's probability for the whole text in column ``name``; null counts as empty."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(t.as_py() or "") for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The network learns only from labelled rows that are not held out. Every row is scored for itself, so repeated
    rows, null ids (never held out) and extra columns are fine; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = with_score(src, trained(docs, labels, id_col, text_col, label_col), "text", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> ByteCnn:
    sample = training_rows(docs, labels.where(~held_out(F.col(labels.columns[0]))), id_col, text_col, label_col)
    return fit([t for t, _, _ in sample], [y for _, y, _ in sample], [w for _, _, w in sample])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose score is ``cut`` or more, with all their columns. The network learns from the labelled
    rows of ``learn_from``, which has the same columns; of ``docs`` if there is none."""
    net = trained(docs if learn_from is None else learn_from, labels, id_col, text_col, label_col)
    name = "score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return with_score(docs, net, text_col, name).where(F.col(f"`{name}`") >= cut).select(*(f"`{c}`" for c in docs.columns))
