"""Repeated passages: windows of words that also start in a document with a smaller id.

Windows are not shuffled one by one. Consecutive windows with the same minimiser (the least hash of
a few words inside) travel as one packed string to the bucket of that minimiser, and only
if the minimiser is found in two documents. In the bucket the windows themselves are sorted and compared.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .text import batches, mix, only, unused, word_hashes, words

WIDTH = 50
#: Words that a minimiser is made of.
SEED_WORDS = 8
#: Windows that one bucket sorts; those of greater ones are sorted by Spark instead.
BUCKET_ROWS = 50_000
PART = re.compile(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)")


def super_kmers(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same minimiser: document, first window, number of windows, minimiser."""
    seed = min(SEED_WORDS, width)
    x = values.astype(np.int64, copy=False).view(np.uint64)
    n = len(x) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    seeds = x[: len(x) - seed + 1].copy()
    for k in range(1, seed):
        seeds = mix(seeds, x[k : k + len(seeds)])
    least = np.lib.stride_tricks.sliding_window_view(seeds, width - seed + 1).min(axis=1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:n] == doc[width - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    owner, mini = doc[at], least[at]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (mini[1:] != mini[:-1])]))
    size = np.diff(np.append(new, len(at)))
    return owner[new], at[new] - offsets[owner[new]], size, mini[new].view(np.int64)


def _runs(rows: DataFrame, width: int) -> DataFrame:
    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 500):
            owner, start, size, mini = super_kmers(*word_hashes(batch["text"]), width)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch["rid"].take(at), batch["doc_id"].take(at), pa.array(start), pa.array(size), pa.array(mini)],
                ["rid", "doc_id", "start", "size", "mini"],
            )

    return rows.select("rid", "doc_id", "text").mapInArrow(task, "rid bigint, doc_id bigint, start bigint, size bigint, mini bigint")


def _packed(shared: DataFrame, width: int) -> DataFrame:
    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 200):
            rows = []
            for row in batch.to_pylist():
                found = [m[0] for m in PART.findall(row["text"])]
                for p in row["picks"]:
                    a = p["start"]
                    rows.append((p["mini"], p["large"], row["rid"], row["doc_id"], a, " ".join(found[a : a + p["size"] + width - 1])))
            columns = [list(c) for c in zip(*rows)] or [[]] * 6
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            names = ["mini", "large", "rid", "doc_id", "start", "packed"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return shared.mapInArrow(task, "mini bigint, large boolean, rid bigint, doc_id bigint, start bigint, packed string")


def _windows(packed: str, width: int) -> list[str]:
    starts = [0, *[m.end() for m in re.finditer(" ", packed)]]
    ends = [*[s - 1 for s in starts[1:]], len(packed)]
    return [packed[starts[i] : ends[i + width - 1]] for i in range(len(starts) - width + 1)]


def _later(bucket: list[tuple], width: int) -> list[tuple]:
    """Stretches of words (rid, from, to) of windows that another row of the bucket has with a smaller doc_id."""
    found = sorted(
        (window, doc_id, k, i)
        for k, (_, doc_id, _, packed) in enumerate(bucket)
        for i, window in enumerate(_windows(packed, width))
    )
    hits, first = [], None
    for window, doc_id, k, i in found:
        if first is None or window != first[0]:
            first = window, doc_id
        elif doc_id > first[1]:
            hits.append((k, i))
    return [(bucket[k][0], bucket[k][2] + a, bucket[k][2] + b + width) for k, a, b in _joined(sorted(hits))]


def _joined(hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    at = 0
    while at < len(hits):
        end = at
        while end + 1 < len(hits) and hits[end + 1] == (hits[at][0], hits[end][1] + 1):
            end += 1
        yield hits[at][0], hits[at][1], hits[end][1]
        at = end + 1


def _sorted_buckets(packed: DataFrame, width: int) -> DataFrame:
    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)] or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rid", "from", "to"])

        bucket, mini, found = [], None, []
        for batch in batches(parts, 1000):
            for row in zip(*[batch[c].to_pylist() for c in ("mini", "rid", "doc_id", "start", "packed")]):
                if row[0] != mini:
                    if len(bucket) > 1:
                        found += _later(bucket, width)
                    bucket, mini = [], row[0]
                bucket.append(row[1:])
            yield out(found)
            found = []
        if len(bucket) > 1:
            yield out(_later(bucket, width))

    rows = packed.repartition("mini").sortWithinPartitions("mini")
    return rows.select("mini", "rid", "doc_id", "start", "packed").mapInArrow(task, "rid bigint, `from` bigint, `to` bigint")


def _sorted_by_spark(packed: DataFrame, width: int) -> DataFrame:
    """The same for windows of large buckets, keyed each by its 128-bit digest: a bucket is then spread over all tasks."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)] or [[]] * 4
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["window", "rid", "doc_id", "at"])

        for batch in batches(parts, 200):
            rows = []
            for rid, doc_id, start, text in zip(*[batch[c].to_pylist() for c in ("rid", "doc_id", "start", "packed")]):
                for i, window in enumerate(_windows(text, width)):
                    rows.append((hashlib.blake2b(window.encode(), digest_size=16).digest(), rid, doc_id, start + i))
                if len(rows) >= BUCKET_ROWS:
                    yield out(rows)
                    rows = []
            yield out(rows)

    each = settle(packed.mapInArrow(task, "window binary, rid bigint, doc_id bigint, at bigint"))
    first = settle(each.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"))
    later = each.join(first, "window").where("doc_id > first")
    return later.select("rid", F.col("at").alias("from"), (F.col("at") + width).alias("to"))


def _with_rid(docs: DataFrame) -> DataFrame:
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("rid", F.xxhash64("doc_id", "text"))


def repeats(docs: DataFrame, width: int = WIDTH, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """What of each text repeats an earlier document.

    Gives ``(rid, doc_id, n_words, words_sha256, copy)`` for every row, ``copy`` where all its words are those of a
    row with a smaller id and so all its windows repeat, and ``(rid, text, spans)`` for other rows with repeated
    windows, ``spans`` being word positions ``from`` and ``to`` (exclusive) that may overlap. ``rid`` is a hash of
    id and text. Rows with a null id neither lose words nor take any from others; a null text has no words.
    """
    rows = _with_rid(docs)
    found = rows.select("rid", "doc_id", words(F.col("text")).alias("w"))
    members = settle(
        found.select(
            "rid",
            "doc_id",
            F.size("w").cast("bigint").alias("n_words"),
            F.sha2(F.array_join("w", " ").cast("binary"), 256).alias("words_sha256"),
        )
    )
    firsts = settle(members.where("doc_id is not null").groupBy("words_sha256").agg(F.min("doc_id").alias("first")))
    members = members.join(firsts, "words_sha256", "left").select(
        "rid",
        "doc_id",
        "n_words",
        "words_sha256",
        F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= width), F.lit(False)).alias("copy"),
    )
    members = settle(members)
    runs = settle(_runs(rows.where("doc_id is not null"), width))
    runs = runs.join(members.where("copy").select("rid").distinct(), "rid", "left_anti")
    minis = runs.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("size").alias("n"))
    minis = settle(minis.where("lo < hi").select("mini", (F.col("n") > bucket_rows).alias("large")))
    picks = (
        runs.join(minis, "mini")
        .groupBy("rid")
        .agg(F.collect_set(F.struct("start", "size", "mini", "large")).alias("picks"))
    )
    shared = settle(rows.join(picks, "rid"))
    packed = settle(_packed(shared, width).dropDuplicates(["rid", "start"]))
    later = _sorted_buckets(packed.where("not large"), width).union(_sorted_by_spark(packed.where("large"), width))
    spans = later.groupBy("rid").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    return members, settle(shared.select("rid", "text").join(spans, "rid"))


def _cut(spans: list[dict], size: int) -> np.ndarray:
    """Which of ``size`` words stay."""
    steps = np.zeros(size + 1, np.int64)
    for s in spans:
        steps[s["from"]] += 1
        steps[s["to"]] -= 1
    return np.cumsum(steps[:-1]) == 0


def repeat_digests(docs: DataFrame, width: int = WIDTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row: what is left when repeated windows are removed."""
    members, spans = repeats(docs, width, bucket_rows)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 200):
            removed, hashed = [], []
            for row in batch.to_pylist():
                found = [m[0] for m in PART.findall(row["text"])]
                stays = _cut(row["spans"], len(found))
                removed.append(int((~stays).sum()))
                kept = " ".join(w for w, s in zip(found, stays.tolist()) if s)
                hashed.append(hashlib.sha256(kept.encode()).hexdigest())
            columns = [batch["rid"], pa.array(removed, pa.int64()), pa.array(hashed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "some_removed", "some_kept"])

    some = spans.mapInArrow(task, "rid bigint, some_removed bigint, some_kept string").dropDuplicates(["rid"])
    nothing = hashlib.sha256(b"").hexdigest()
    return members.join(some, "rid", "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("some_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("some_kept", "words_sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, width: int = WIDTH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` without words of repeated windows: each goes with the white space after it.

    Rows of which nothing is left go as well; rows without repeats stay as they are, null texts included.
    """
    members, spans = repeats(docs, width, bucket_rows)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 200):
            texts = []
            for row in batch.to_pylist():
                found = PART.findall(row["text"])
                lead = row["text"][: len(row["text"]) - sum(len(a) + len(b) for a, b in found)]
                stays = _cut(row["spans"], len(found)).tolist()
                texts.append(lead + "".join(a + b for (a, b), s in zip(found, stays) if s))
            yield pa.RecordBatch.from_arrays([batch["rid"], pa.array(texts, pa.string())], ["rid", "text"])

    some = spans.mapInArrow(task, "rid bigint, text string").dropDuplicates(["rid"])
    gone = members.where("copy").select("rid", F.lit("").alias("text")).distinct()
    own, new = unused(docs, "_rid"), unused(docs, "_text")
    changed = some.unionByName(gone).select(F.col("rid").alias(own), F.col("text").alias(new))
    rid = F.xxhash64(F.col("`doc_id`").cast("bigint"), F.coalesce("`text`", F.lit("")))
    joined = docs.withColumn(own, rid).join(changed, own, "left")
    joined = joined.where(F.col(new).isNull() | F.col(new).rlike("[^\\x20\\x09-\\x0D]"))
    return joined.select(
        *[F.coalesce(new, "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    )
