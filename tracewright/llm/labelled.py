"""Bounded samples of labelled rows, and weights learnt from one in a single task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold, only


def sample_ids(labels: DataFrame, value: str, rows: int, keep: Column | None = None) -> DataFrame:
    """At most ``rows`` ids with their label, those with the smallest hash of the id.

    Rows with a null id or label take no part; an id with several labels has the greatest.
    """
    known = only(labels, "doc_id", value).where(F.col("doc_id").isNotNull() & F.col(f"`{value}`").isNotNull())
    if keep is not None:
        known = known.where(keep)
    one = known.groupBy("doc_id").agg(F.max(F.col(f"`{value}`")).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def not_held_out(parts: int, out: int) -> Column:
    return fold(F.col("doc_id"), parts) != out


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, label, text`` of a bounded table of ids; of rows that repeat an id, the least text."""
    found = only(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text"))


def learn(rows: DataFrame, fit: Callable[[pa.Table], pa.Table], schema: str) -> list:
    """Rows that ``fit`` makes of all ``rows``, a bounded sample, in one task and in the order of the ids."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(parts)
        if found:
            table = pa.Table.from_batches(found).combine_chunks().sort_by("doc_id")
            yield from fit(table).to_batches()

    return rows.repartition(1).mapInArrow(task, schema).collect()


def packed(weights: np.ndarray) -> bytes:
    return np.ascontiguousarray(weights, np.float32).tobytes()
