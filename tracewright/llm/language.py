"""Language by two steps: the family first, then linear support vector machines, one against one, that vote within it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import attach
from ..session import settle
from . import grams
from .labelled import learn
from .text import batches, fold, only, text_bytes

#: Families of common codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
#: Labelled rows to learn from, at most, in all and for each language.
SAMPLE_ROWS, PER_LANGUAGE = 2400, 600
ROUNDS, PENALTY = 80, 1e-3
#: Ids are counted in 2^RANGE_BITS ranges of their hash before they are put in order.
RANGE_BITS = 16


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), f"only {lang}")


def svm(x: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of machines: squared hinge loss, L2 penalty, all rows at once.

    ``wanted`` has a column for each machine: +1 and -1 for the rows of its two sides, 0 for those that take no part.
    """
    n, size = x.shape
    share = np.maximum(1, (wanted > 0).sum(axis=0)), np.maximum(1, (wanted < 0).sum(axis=0))
    cost = np.where(wanted > 0, 0.5 / share[0], np.where(wanted < 0, 0.5 / share[1], 0.0))
    step = 1 / (2 * (x * x).sum(axis=1).max() * cost.sum(axis=0).max() + 2 * PENALTY + 2)
    w, b = np.zeros((size, wanted.shape[1]), np.float32), np.zeros(wanted.shape[1])
    ahead, ahead_b, pace = w, b, 1.0
    for _ in range(ROUNDS):
        slack = cost * wanted * np.maximum(0, 1 - wanted * (x @ ahead + ahead_b))
        new = ahead + step * (2 * (x.T @ slack.astype(np.float32)) - PENALTY * ahead)
        new_b = ahead_b + step * 2 * slack.sum(axis=0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, ahead_b = new + (pace - 1) / faster * (new - w), new_b + (pace - 1) / faster * (new_b - b)
        w, b, pace = new.astype(np.float32), new_b, faster
    return w, b


def _fit(table: pa.Table) -> pa.Table:
    shares = grams.dense(*text_bytes(table["text"].combine_chunks()))
    scale = grams.scales(shares)
    shares *= scale
    lang = np.array(table["label"].to_pylist())
    kin = np.array([family(x) for x in lang])
    families = sorted(set(kin))
    # families against all others, and in each family every language against every other
    groups = [("", families, np.ones(len(lang), bool), np.where(kin[:, None] == np.array(families), 1.0, -1.0))]
    for name in families:
        rows = kin == name
        classes = sorted(set(lang[rows]))
        sides = [(lang[rows] == x).astype(float) - (lang[rows] == y) for x, y in combinations(classes, 2)]
        groups.append((name, classes, rows, np.stack(sides, axis=1) if sides else np.zeros((rows.sum(), 0))))
    out = []
    for name, classes, rows, wanted in groups:
        w, b = svm(shares[rows], wanted) if wanted.shape[1] else (np.zeros((grams.SIZE, 0), np.float32), np.zeros(0))
        out.append((name, json.dumps(classes), (w * scale[:, None]).astype(np.float32).tobytes(), json.dumps(b.tolist())))
    return pa.table(dict(zip(("name", "classes", "w", "b"), map(list, zip(*out)))))


def elected(margin: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The class that most machines vote for in each row, and the mean confidence of its machines.

    ``margin`` has a column for each pair of classes in order, positive for the first one. Of classes with as many
    votes the one with the greatest sum of margins is taken, then the first.
    """
    votes, total, sure = (np.zeros((len(margin), classes)) for _ in range(3))
    for k, (x, y) in enumerate(combinations(range(classes), 2)):
        m = margin[:, k]
        votes[:, x] += m > 0
        votes[:, y] += m <= 0
        total[:, x] += m
        total[:, y] -= m
        p = 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
        sure[:, x] += p
        sure[:, y] += 1 - p
    best = np.where(votes == votes.max(axis=1, keepdims=True), total, -np.inf).argmax(axis=1)
    if classes == 1:
        return best, np.ones(len(margin))
    return best, sure[np.arange(len(best)), best] / (classes - 1)


def _first_of_each(known: DataFrame, each: int) -> DataFrame:
    """(doc_id, lang, k): the ``each`` smallest ids by hash of every language, numbered.

    Ids are counted by ranges of their hash first, so that only those of the ranges that are needed are put in order.
    """
    ids = settle(known.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id")))
    at = F.shiftright("h", 64 - RANGE_BITS)
    counted = ids.groupBy("lang", at.alias("at")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("at")) - F.col("n")
    last = counted.withColumn("before", before).where(F.col("before") < each).groupBy("lang").agg(F.max("at").alias("last"))
    needed = attach(ids, last, ["lang"]).where(at <= F.col("last"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    return needed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("doc_id", "lang", "k")


def train(docs: DataFrame, keep=None, rows: int = SAMPLE_ROWS, each: int = PER_LANGUAGE) -> list[tuple]:
    """Machines for families and within each: name, classes, weights, biases. The first (named "") has one for each family,
    against all others; a family of k languages has k(k-1)/2, one for each pair in order.

    Learns from at most ``each`` documents of a language, and ``rows`` of all, by the smallest hash of
    the id. Rows with a null id, text or lang take no part.
    """
    known = only(docs, "doc_id", "lang", "text").where("doc_id is not null and lang is not null and text is not null")
    known = known if keep is None else known.where(keep)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = _first_of_each(known, each).orderBy("k", *order, "lang").limit(rows).select("doc_id", F.col("lang").alias("label"))
    named = known.withColumnRenamed("lang", "label").join(F.broadcast(ids), ["doc_id", "label"])
    text = named.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = learn(text, _fit, "name string, classes string, w binary, b string")
    out = []
    for r in found:
        classes = json.loads(r.classes)
        out.append((r.name, classes, np.frombuffer(r.w, np.float32).reshape(grams.SIZE, -1 if r.w else 0), np.array(json.loads(r.b))))
    return sorted(out, key=lambda m: m[0])


def predict(docs: DataFrame, machines: list[tuple]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; ``und`` and 0 for a text that is null or has no letter, and
    for all texts without machines. The score is the family's share in the softmax of the families' margins times the mean
    confidence of the language's machines."""
    sent = docs.sparkSession.sparkContext.broadcast(machines)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        if found:
            start = np.cumsum([0, *[m[2].shape[1] for m in found]])
            w = np.hstack([m[2] for m in found]).astype(np.float64)
        for batch in batches(parts, 2000):
            n = batch.num_rows
            lettered = batch["lettered"].to_numpy(zero_copy_only=False)
            lang, score = np.full(n, "und", object), np.zeros(n)
            if found and n:
                margin = grams.scores(*text_bytes(batch["text"]), w)
                margin = [margin[:, a:b] + m[3] for a, b, m in zip(start[:-1], start[1:], found)]
                soft = np.exp(4 * (margin[0] - margin[0].max(axis=1, keepdims=True)))
                soft /= soft.sum(axis=1, keepdims=True)
                chosen = soft.argmax(axis=1)
                for k, name in enumerate(found[0][1]):
                    at = next(i for i, m in enumerate(found) if m[0] == name)
                    rows = np.flatnonzero((chosen == k) & lettered)
                    best, sure = elected(margin[at][rows], len(found[at][1]))
                    lang[rows] = np.array(found[at][1], object)[best]
                    score[rows] = soft[rows, k] * sure
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(lang.tolist(), pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "score"],
            )

    text = F.coalesce("text", F.lit(""))
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), text.alias("text"), text.rlike("\\p{L}").alias("lettered"))
    return rows.mapInArrow(task, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, parts: int = 4, out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text, lang``).

    Learns only from rows whose crc32 of the id modulo ``parts`` is not ``out``; a null id counts as held out.
    """
    machines = train(docs, fold(F.col("doc_id"), parts) != out)
    held = F.coalesce(fold(F.col("doc_id"), parts) == out, F.lit(True))
    return predict(docs, machines).select("doc_id", held.alias("held_out"), "lang_pred", "score")
