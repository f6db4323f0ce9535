"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import learn, not_held_out, sample_ids, texts_of
from .text import batches, fold, hashes, mix, only, plain_words, ragged

BITS = 20
#: Labelled rows to learn from, at most.
SAMPLE_ROWS = 12_000
EPOCHS = 3
#: Learning rate, its offset, and the L1 and L2 penalties, chosen on a part of the rows to learn from.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 20.0, 1.0
#: A rare label counts for as much as the other one, but a row of it at most so many times.
MOST_WEIGHT = 10.0


def features(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the document each belongs to: words, neighbours, words with one between them."""
    x = values.astype(np.int64, copy=False).view(np.uint64)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    found, owner = [mix(x, np.full(len(x), 1, np.uint64))], [doc]
    for gap in (1, 2):
        if len(x) > gap:
            inside = doc[:-gap] == doc[gap:]
            found.append(mix(mix(x[:-gap], x[gap:]), np.full(len(x) - gap, gap + 1, np.uint64))[inside])
            owner.append(doc[:-gap][inside])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owner)


def distinct(feature: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a document once, by document."""
    both = np.unique((owner << BITS) | feature)
    return both & ((1 << BITS) - 1), both >> BITS


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    rate = (BETA + np.sqrt(n)) / ALPHA + L2
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / rate)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights by feature, most of them zero, and the bias, from rows of distinct features."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    ones = max(1.0, labels.sum())
    cost = np.where(labels > 0, np.clip((len(labels) - ones) / ones, 1, MOST_WEIGHT), 1.0)
    for epoch in range(epochs):
        for at in np.random.default_rng(epoch).permutation(len(rows)):
            idx = np.append(rows[at], size - 1)
            w = _weights(z[idx], n[idx])
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = cost[at] * (p - labels[at])
            step = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA
            z[idx] += g - step * w
            n[idx] += g * g
    w = _weights(z, n)
    return w[:-1], float(w[-1])


def _fit(table: pa.Table) -> pa.Table:
    values, offsets = ragged(table["w"].combine_chunks())
    rows = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        found, owner = features(values[a:b], np.array([0, b - a]))
        rows.append(distinct(found, owner)[0].astype(np.int32))
    w, bias = ftrl(rows, table["label"].to_numpy().astype(float))
    at = np.flatnonzero(w)
    return pa.table({"feature": pa.array(np.append(at, -1)), "weight": pa.array(np.append(w[at], bias))})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, keep=None) -> dict:
    """Non-zero weights by feature, and the bias at -1, from at most ``rows`` labelled documents."""
    text = texts_of(sample_ids(labels, label, rows, keep), docs)
    hashed = text.select("doc_id", F.col("label").cast("double").alias("label"), hashes(plain_words(F.col("text"))).alias("w"))
    return {r.feature: r.weight for r in learn(hashed, _fit, "feature bigint, weight double")}


def score(docs: DataFrame, weights: dict) -> DataFrame:
    """``doc_id`` and ``score``, 0 to 1, of every row of ``docs``; null and empty texts get that of the bias alone.

    ``weights`` has at most 2^20 entries, and is sent along with the tasks.
    """
    table = np.zeros(1 << BITS, np.float32)
    at = np.array([k for k in weights if k >= 0], np.int64)
    table[at] = [weights[k] for k in at.tolist()]
    bias = weights.get(-1, 0.0)
    sent = docs.sparkSession.sparkContext.broadcast((at, table[at]))

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = sent.value
        w = np.zeros(1 << BITS)
        w[known] = values
        for batch in batches(parts, 1000):
            feature, owner = features(*ragged(batch["w"]))
            some = w[feature] != 0
            feature, owner = distinct(feature[some], owner[some])
            total = np.bincount(owner, weights=w[feature], minlength=batch.num_rows) + bias
            out = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(out)], ["doc_id", "score"])

    hashed = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), hashes(plain_words(F.col("text"))).alias("w"))
    return hashed.mapInArrow(task, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, out: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``).

    Learns from ``labels`` (``doc_id, toxic``) whose crc32 of the id modulo ``parts`` is not ``out``,
    at most ``SAMPLE_ROWS`` of them. Without labels all scores are one half. Repeated documents get
    equal scores; a null id counts as held out.
    """
    scored = score(docs, train(docs, labels, keep=not_held_out(parts, out)))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), parts) == out, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
