"""Words, hashes and folds shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between words: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters outside ``GAP``, unchanged and in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def hashes(array: Column) -> Column:
    """A 64-bit hash of each element."""
    return F.transform(array, lambda x: F.xxhash64(x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return values.to_numpy(zero_copy_only=False), offsets - offsets[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    split = pc.ascii_split_whitespace(texts)
    offsets = split.offsets.to_numpy()
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    distinct, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
    at = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if at >= 0:  # beside white space at the ends of a text
        some = code != at
        offsets = np.concatenate([[0], np.cumsum(some)])[offsets]
        code = code[some]
        code = code - (code > at)
        distinct = np.delete(distinct, at)
    return distinct, code, offsets


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words between ASCII white space, each word's number among them, and where each text's words begin and end."""
    distinct, code, offsets = _coded(texts)
    return distinct.tolist(), code, offsets


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, one after the other, and where each text's begin and end."""
    distinct, code, offsets = _coded(texts)
    if not len(distinct):
        return np.zeros(0, np.int64), offsets
    found = pd.util.hash_array(distinct, categorize=False)
    return found[code].view(np.int64), offsets


def mix(a: np.ndarray, b: np.ndarray, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit hashes."""
    x = (a * np.uint64(odd)) ^ (a >> np.uint64(29))
    x = (x + b) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive words, one for each start, of one document's word hashes.

    A document with fewer words, but at least one, gives its whole sequence.
    """
    x = hashed.view(np.uint64)
    width = min(width, len(x))
    if not width:
        return x
    n = len(x) - width + 1
    out = mix(np.full(n, width, np.uint64), x[:n])
    for k in range(1, width):
        out = mix(out, x[k : k + n])
    return out


def all_shingles(hashed: np.ndarray, offsets: np.ndarray, width: int, step: int = 1 << 15) -> Iterator[np.ndarray]:
    """``shingles`` of each document, whose word hashes lie one after the other, made of ``step`` words at a time."""
    # those that begin in one document and end in another are made as well, but not read
    made = [shingles(hashed[k : k + step + width - 1], width) for k in range(0, max(1, len(hashed) - width + 1), step)]
    flat = np.concatenate(made)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield flat[a : b - width + 1] if b - a >= width else shingles(hashed[a:b], width)


def batches(frame: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in frame:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact name, so that extra ones do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def grouped(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """A table for each run of rows with equal integer ``keys``, of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in parts:
        if not batch.num_rows:
            continue
        key = np.stack([batch[k].to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and any(held[-1][k][-1].as_py() != batch[k][0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
