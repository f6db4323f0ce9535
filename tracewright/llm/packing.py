"""Pack token sequences: best fit, then local search that moves and swaps pieces until bins empty."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle_measured
from .text import batches, coded_words, only, unused

CAPACITY = 4096
END_ID = 1
#: Pieces packed together, about. Groups are packed apart from each other, so each may leave one bin underfull.
GROUP_PIECES = 16_384
#: Words whose ids a task remembers before it forgets them all.
REMEMBERED = 600_000
#: A word of Latin letters alone (A-Z, a-z, U+00C0 to U+00FF without the two signs), perhaps with a stop or comma after it.
LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?$"
#: Words given to the tokenizer as one sequence.
SEQUENCE = 4000


class WordIds:
    """Token ids of words between ASCII white space.

    The tokenizer works on each such word for itself (it normalises and splits at white space), so the ids
    of a text are those of its words in order. A word is one or two units: a Latin word is looked up in lower case, and
    apart from a stop or comma after it. Each unit is encoded once as long as it is remembered, in a sequence of many
    units whose ids say which one they are from; its ids stand in one long array. Unit 0 is empty.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.unit: dict[str, int] = {"": 0}
        self.units = np.zeros((0, 2), np.int64)
        self.start, self.flat = np.zeros(2, np.int64), np.zeros(0, np.uint32)
        self._encode([".", ","])

    def _encode(self, new: list[str]) -> None:
        """Number new units and keep their ids."""
        self.unit.update(zip(new, range(len(self.unit), len(self.unit) + len(new))))
        runs = [new[at : at + SEQUENCE] for at in range(0, len(new), SEQUENCE)]
        flat, sizes = [self.flat], []
        for run, found in zip(runs, self.encoder.encode_batch(runs, is_pretokenized=True, add_special_tokens=False)):
            flat.append(np.array(found.ids, np.uint32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(run)))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))])
        self.flat = np.concatenate(flat)

    def _learn(self, new: list[str]) -> None:
        """Number new words and say which units they are made of."""
        words = pa.array(new, pa.large_string())
        latin = pc.match_substring_regex(words, LATIN)
        stems = pc.if_else(latin, pc.utf8_lower(pc.utf8_rtrim(words, ".,")), words).to_numpy(zero_copy_only=False).tolist()
        unit = self.unit
        unknown = list(dict.fromkeys(x for x in stems if x not in unit))
        if unknown:
            self._encode(unknown)
        made = np.zeros((len(new), 2), np.int64)
        made[:, 0] = np.fromiter(map(unit.__getitem__, stems), np.int64, len(new))
        for end in ".,":
            ends = pc.and_(latin, pc.ends_with(words, end)).to_numpy(zero_copy_only=False)
            made[ends, 1] = unit[end]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.units = np.concatenate([self.units, made])

    def numbers(self, found: list[str]) -> np.ndarray:
        """The number of each word."""
        if len(self.number) > REMEMBERED:
            self._forget()
        new = [w for w in found if w not in self.number]
        if new:
            self._learn(new)
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))


@lru_cache(maxsize=2)
def _encoder(tokenizer: str) -> WordIds:
    """One for all tasks of a worker."""
    return WordIds(tokenizer)


def flat_ids(texts: pa.Array, encoder: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and where each text's begin and end."""
    distinct, code, offsets = coded_words(texts)
    number = encoder.numbers(distinct)[code]
    units = encoder.units[number].ravel()
    first = encoder.start[units]
    size = encoder.start[units + 1] - first
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
    return encoder.flat[at], ends[2 * offsets]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and then ``END_ID``, cut only where
    longer than ``capacity``. A null text counts as empty and gives the end id alone."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches(parts, 1000):
            ids, offsets = flat_ids(batch["text"], encoder)
            rows, whole, end = [], ids.astype("<u4").tobytes(), np.array([END_ID], "<u4").tobytes()
            for doc, a, b in zip(batch["doc_id"].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = whole[4 * a : 4 * b] + end
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = [list(c) for c in zip(*rows)] or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(task, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class _Free:
    """Bins by free space: finds the least space that is at least as large as asked for."""

    def __init__(self, capacity: int):
        self.bins: list[set] = [set() for _ in range(capacity + 1)]
        self.some = 0

    def add(self, free: int, at: int) -> None:
        self.bins[free].add(at)
        self.some |= 1 << free

    def drop(self, free: int, at: int) -> None:
        self.bins[free].discard(at)
        if not self.bins[free]:
            self.some &= ~(1 << free)

    def least(self, size: int) -> int:
        """The least free space of ``size`` or more of any bin, or -1."""
        left = self.some >> size
        return size + (left & -left).bit_length() - 1 if left else -1


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    free, bins = _Free(capacity), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        space = free.least(size)
        if space < 0:
            at, space = len(bins), capacity
            bins.append([])
        else:
            at = min(free.bins[space])
            free.drop(space, at)
        bins[at].append(item)
        if space > size:
            free.add(space - size, at)
    return bins


class _Offers:
    """What underfull bins can give for a greater piece: nothing, one piece or two. Rows are in the order in which they were made."""

    def __init__(self, capacity: int):
        self.capacity, self.n, self.dead, self.clock = capacity, 0, 0, 0
        self.rows = np.zeros((5, 4096), np.int32)  # what is given, room of the bin, bin, sizes of the pieces given or 0
        self.made = np.zeros(4096, np.int64)
        self.at: dict[int, tuple[int, int]] = {}

    def drop(self, at: int) -> None:
        lo, hi = self.at.pop(at, (0, 0))
        self.rows[0, lo:hi] = self.capacity + 1
        self.dead += hi - lo

    def put(self, at: int, sizes: list[int], room: int) -> None:
        """The offers of a bin instead of those it had. Of offers as large, the one of fewer pieces."""
        self.drop(at)
        if room <= 0 or not sizes:
            return
        size, count = np.unique(np.array(sizes, np.int32), return_counts=True)
        x, y = np.triu_indices(len(size))
        two = (x != y) | (count[x] > 1)
        x, y = size[x[two]], size[y[two]]
        zero = np.zeros(1 + len(size), np.int32)
        one, other = np.concatenate([zero[:1], size, x]), np.concatenate([zero, y])
        give, first = np.unique(one + other, return_index=True)
        some = give < self.capacity
        give, first = give[some], first[some]
        hi = self.n + len(give)
        if hi > len(self.made):
            self._make_room(hi)
            hi = self.n + len(give)
        self.rows[:, self.n : hi] = give, np.full(len(give), room), np.full(len(give), at), one[first], other[first]
        self.clock += 1
        self.made[self.n : hi] = self.clock
        self.at[at], self.n = (self.n, hi), hi

    def _make_room(self, size: int) -> None:
        alive = np.flatnonzero(self.rows[0, : self.n] <= self.capacity)
        rows, made = self.rows[:, alive], self.made[alive]
        more = 2 * max(len(alive), size - self.n, 2048)
        self.rows, self.made = np.zeros((5, more), np.int32), np.zeros(more, np.int64)
        self.n, self.dead = len(alive), 0
        self.rows[:, : self.n], self.made[: self.n] = rows, made
        cuts = np.flatnonzero(np.diff(rows[2], prepend=-1, append=-1))
        self.at = {int(rows[2, lo]): (int(lo), int(hi)) for lo, hi in zip(cuts[:-1], cuts[1:])}

    def find(self, size: int, source: int, fill: int, since: int) -> tuple[int, list[int]] | None:
        """The fullest bin, at least as full as ``source``, that takes a piece and gives less, of offers made after ``since``."""
        lo = int(np.searchsorted(self.made[: self.n], since, side="right"))
        give, room, at, one, other = self.rows[:, lo : self.n]
        hit = np.flatnonzero((give < size) & (give + room >= size) & (room <= self.capacity - fill))
        hit = hit[at[hit] != source]
        if not len(hit):
            return None
        hit = hit[room[hit] == room[hit].min()]
        hit = hit[at[hit] == at[hit].min()]
        k = hit[np.lexsort((give[hit], other[hit] > 0, one[hit] > 0))[0]]
        return int(at[k]), [int(x) for x in (one[k], other[k]) if x]


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Fewer or fuller bins by moves that each make the sum of squared fills greater.

    Bins are gone through from the emptiest on: each of its items, the longest first, is moved to the fullest bin with
    room, or exchanged for one item, or two, of a fuller underfull bin such that this bin gets fuller and the emptier one
    emptier still. A bin without items is closed. A bin from which nothing can be moved is only compared with
    those that change after that. Each move raises the sum of squares of whole numbers, which has an upper bound,
    so the search ends: when no bin has a move, or at the least number of bins there can be. Every item stays packed throughout.
    """
    size = lengths.tolist()
    bins = [list(b) for b in bins]
    fill = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    count, offers = len(bins), _Offers(capacity)
    if count <= least:
        return bins
    for at, own in enumerate(bins):
        offers.put(at, [size[i] for i in own], capacity - fill[at])
    checked = [-1] * len(bins)

    def take(at: int, wanted: int) -> int:
        item = next(i for i in bins[at] if size[i] == wanted)
        bins[at].remove(item)
        return item

    def better(source: int) -> bool:
        """One move or exchange out of ``source``, if there is one."""
        for wanted in sorted({size[i] for i in bins[source]}, reverse=True):
            found = offers.find(wanted, source, fill[source], checked[source])
            if found:
                target, given = found
                back = [take(target, x) for x in given]
                bins[target].append(take(source, wanted))
                bins[source] += back
                fill[target] += wanted - sum(given)
                fill[source] -= wanted - sum(given)
                for at in (source, target):
                    offers.put(at, [size[i] for i in bins[at]], capacity - fill[at])
                    checked[at] = -1
                return True
        checked[source] = offers.clock
        return False

    moved = True
    while moved and count > least:
        moved = False
        for source in sorted((i for i in range(len(bins)) if bins[i] and fill[i] < capacity), key=lambda i: (fill[i], i)):
            while bins[source] and fill[source] < capacity and count > least and better(source):
                moved = True
                count -= not bins[source]
    return [b for b in bins if b]


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP_PIECES) -> DataFrame:
    """``items`` (with ``length``, at most ``capacity``) and their ``sequence_id`` and ``offset`` in it.

    Items are dealt evenly over groups of about ``group`` by a hash of the row, and each group is packed for itself.
    """
    table, rows, _, _ = settle_measured(items)
    groups = max(1, -(-rows // group))
    key = unused(items, "_group")
    dealt = table.withColumn(key, F.pmod(F.xxhash64(*items.columns), F.lit(groups)))
    names = items.columns

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names, kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, items_in in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            sizes = lengths[items_in]
            sequence[items_in] = (int(pdf[key].iloc[0]) << 32) + k
            offset[items_in] = np.cumsum(sizes) - sizes
        return pdf[names].assign(sequence_id=sequence, offset=offset)

    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy(key).applyInPandas(task, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP_PIECES) -> DataFrame:
    """Sequences of at most ``capacity`` tokens that hold all ``docs`` (``doc_id, text``), a row for each piece:
    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Repeated rows are packed once each; no rows give none."""
    return pack(pieces(docs, tokenizer, capacity), capacity, group)
