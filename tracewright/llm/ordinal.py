"""Graded quality by cumulative-link regression: one weighted sum per text, ordered thresholds between grades."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .labelled import learn, not_held_out, sample_ids, texts_of
from .text import batches, fold, only, text_bytes

#: Labelled rows to learn from, at most.
SAMPLE_ROWS = 2400
ROUNDS, RATE, PENALTY = 100, 0.05, 1e-3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(x: np.ndarray, grade: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ``grades`` - 1 ascending thresholds: P(grade > k) = sigmoid(x w - threshold k).

    Thresholds are a first one plus exponentials, so they stay in order. Adam on the mean negative
    log likelihood of all rows, with an L2 penalty on the weights.
    """
    n, size = x.shape
    steps = np.zeros(grades - 1)
    shared = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(0.01, 0.99)
    steps[0] = -np.log(shared[0] / (1 - shared[0]))
    params = np.concatenate([np.zeros(size), steps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, ROUNDS + 1):
        w, steps = params[:size], params[size:]
        cut = np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))
        over = _sigmoid((x @ w.astype(np.float32))[:, None] - cut)
        tail = np.hstack([np.ones((n, 1)), over, np.zeros((n, 1))])
        slope = tail * (1 - tail)
        at = np.arange(n)
        p = np.maximum(tail[at, grade] - tail[at, grade + 1], 1e-9)
        up, down = slope[at, grade] / p, slope[at, grade + 1] / p
        g_w = -(x.T @ ((up - down) / n).astype(np.float32)) + PENALTY * w
        g_cut = np.zeros(grades + 1)
        np.add.at(g_cut, grade, up / n)
        np.add.at(g_cut, grade + 1, -down / n)
        g_cut = g_cut[1:-1]
        after = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([g_w, after[:1], after[1:] * np.exp(steps[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w, steps = params[:size], params[size:]
    return w, np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))


def _fit(table: pa.Table) -> pa.Table:
    shares = grams.dense(*text_bytes(table["text"].combine_chunks()))
    scale = grams.scales(shares) / np.sqrt(np.sqrt(grams.SIZE))
    label = table["label"].to_numpy()
    known = np.unique(label)
    if len(known) > 1:
        w, cut = fit(shares * scale, np.searchsorted(known, label), len(known))
    else:
        w, cut = np.zeros(grams.SIZE), np.zeros(0)
    return pa.table({"w": [(w * scale).astype(np.float32).tobytes()], "model": [json.dumps([known.tolist(), cut.tolist()])]})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, keep=None):
    """Weights, the grades in order and the thresholds between them; no grades when nothing is labelled."""
    text = texts_of(sample_ids(labels, label, rows, keep), docs)
    text = text.withColumn("label", F.col("label").cast("double"))
    found = learn(text, _fit, "w binary, model string")
    if not found:
        return np.zeros((grams.SIZE, 1)), [], []
    return (np.frombuffer(found[0].w, np.float32).reshape(-1, 1), *json.loads(found[0].model))


def quality_grades(docs: DataFrame, labels: DataFrame, parts: int = 5, out: int = 0) -> DataFrame:
    """``doc_id, held_out, expected_grade, tail_probability, selected`` for every row of ``docs`` (``doc_id, text``).

    Learns from ``labels`` (``doc_id, quality``) whose crc32 of the id modulo ``parts`` is not ``out``, at most
    ``SAMPLE_ROWS`` of them. The tail probability is that of the highest grade; ``selected`` where it is one half or more.
    With a single grade that grade is expected everywhere, with certainty; without labels both numbers are null and nothing
    is selected. Null texts count as empty; a null id counts as held out.
    """
    w, grades, cut = train(docs, labels, keep=not_held_out(parts, out))
    sent = docs.sparkSession.sparkContext.broadcast((w.astype(np.float64), grades, cut))

    def task(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known, cuts = sent.value
        for batch in batches(batches_in, 2000):
            n = batch.num_rows
            if known:
                at = grams.scores(*text_bytes(batch["text"]), weights)
                over = np.hstack([np.ones((n, 1)), _sigmoid(at - np.array(cuts)[None, :]), np.zeros((n, 1))])
                expected, tail = (over[:, :-1] - over[:, 1:]) @ np.array(known), over[:, -2]
            else:
                expected = tail = [None] * n
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())],
                ["doc_id", "expected_grade", "tail_probability"],
            )

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(task, "doc_id bigint, expected_grade double, tail_probability double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), parts) == out, F.lit(True)).alias("held_out"),
        "expected_grade",
        "tail_probability",
        F.coalesce(F.col("tail_probability") >= 0.5, F.lit(False)).alias("selected"),
    )
