"""Phrases of two to four words that occur together more often than their parts suggest.

Every place of a text is a suffix of at most four words. Suffixes are dealt out by their first words: a
word with few enough places has one group to itself or shares it with others, and the places of a more
frequent word are dealt out by its first two, three or four words. What a group holds fits in one
task, which sorts its suffixes (a subtree cut off at depth four) and reads each phrase's frequency from the totals of
the leaves below it. Only a phrase shorter than what its places are dealt out by has leaves in several groups, whose totals are added.

Words are 64-bit numbers while they travel; that no two words share one is checked against the table of words, and
another salt is taken if they do.

Null texts are empty, a null ``lang`` is ``und``. Rows that repeat count as often as they occur; other columns are not read.
Tables without words give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import BROADCAST_BYTES, attach
from ..session import Settled, settle, settle_measured
from .text import mix, only, text_bytes

LONGEST = 4
#: Suffixes that one group may hold: about 36 bytes each, and as much again to sort them.
BUDGET = 1 << 19
#: Text bytes that a task works on at once; a longer text is worked on alone.
SLICE_BYTES = 2 << 20
#: Bits for each frequent word in the filter that cuts suffixes at rare words, and the most that it has in all (8 MB).
FILTER_SHARE, FILTER_BITS = 16, 1 << 26
BUCKET_BITS = 1 << 15
#: The last plan attaches six tables, which the driver holds at the same time: each may have a share of what one may.
ATTACH_BYTES = BROADCAST_BYTES // 8

_KIND = np.zeros(256, np.uint8)
_KIND[:] = np.arange(256)
_KIND[ord("A") : ord("Z") + 1] += 32
_KIND[ord("\t")] = ord(" ")
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = ord("\n")

WORDS = [f"c{k}" for k in range(LONGEST)]
PLACES = ", ".join(f"{c} bigint" for c in WORDS)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows of the batch in runs of about ``SLICE_BYTES`` of the text column."""
    _, offsets = text_bytes(batch[column])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lower-cased words of all texts, each one's row, and a number that words of the same piece share."""
    data, offsets = text_bytes(texts)
    x = _KIND[data]
    gap = (x == ord(" ")) | (x == ord("\n"))
    first = np.zeros(len(x) + 1, bool)
    first[offsets] = True
    begins = ~gap & (first[:-1] | np.concatenate([[True], gap[:-1]])[: len(x)])
    ends = ~gap & (first[1:] | np.concatenate([gap[1:], [True]])[: len(x)])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    places = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.Array.from_buffers(
        pa.large_string(), len(start), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(x[~gap].tobytes())]
    )
    row = np.searchsorted(offsets, start, "right") - 1
    breaks = np.flatnonzero((x == ord("\n")) | first[:-1])
    return words, row, np.searchsorted(breaks, start, "right")


def word_numbers(batch: pa.RecordBatch, salt: int) -> tuple:
    """Distinct words, each word's place among them, its language's, its number and its piece."""
    words, row, piece = split_words(batch["text"])
    coded = words.dictionary_encode()
    distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    langs = batch["lang"].dictionary_encode()
    spoken, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)[row]
    if not distinct:
        return [], spoken, code, lang, np.zeros(0, np.uint64), piece
    key = f"{salt:016d}"
    by_word, by_lang = (pd.util.hash_array(np.array(x, object), hash_key=key, categorize=False) for x in (distinct, spoken))
    numbers = mix(by_lang[lang], by_word[code])
    return distinct, spoken, code, lang, np.maximum(numbers, np.uint64(1)), piece


def _vocabulary(docs: DataFrame, salt: int) -> Settled:
    """``lang, word, id, n``: how often each word occurs."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for piece in slices(batch, "text"):
                distinct, spoken, code, lang, numbers, _ = word_numbers(piece, salt)
                if not distinct:
                    continue
                pair, at, n = np.unique(lang.astype(np.int64) * len(distinct) + code, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(spoken).take(pa.array(pair // len(distinct))),
                        pa.array(distinct).take(pa.array(pair % len(distinct))),
                        pa.array(numbers[at].view(np.int64)),
                        pa.array(n.astype(np.int64)),
                    ],
                    ["lang", "word", "id", "n"],
                )

    counted = docs.mapInArrow(task, "lang string, word string, id bigint, n bigint")
    return settle_measured(counted.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")))


def _frequent_bits(frequent: DataFrame, rows: int) -> np.ndarray:
    """A bitmap with the bit of every frequent word set; of bounded size, so others may share a bit."""
    bits = BUCKET_BITS
    while bits < min(FILTER_BITS, rows * FILTER_SHARE):
        bits *= 2
    bit = F.pmod(F.col("id"), F.lit(bits)) + 1  # Spark's bitmaps start from 1
    buckets = frequent.groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
    out = np.zeros((bits // BUCKET_BITS, BUCKET_BITS // 8), np.uint8)
    for bucket, bitmap in buckets.agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit))).collect():
        out[bucket - 1] = np.frombuffer(bitmap, np.uint8)
    return out.reshape(-1)


class Shares:
    """Words of more than ``budget`` places, whose suffixes are dealt out by more words than the first.

    Level 0 has the shares of each such word, by its second word; level ``d`` those of each share of the level before, by one
    word more, 1 where that share is small enough.
    """

    def __init__(self, words: np.ndarray, places: np.ndarray, budget: int) -> None:
        order = np.argsort(words)
        self.words, self.budget = words[order], budget
        self.levels = [-(-places[order] // budget)] if len(words) else []

    def deepen(self, places: np.ndarray) -> bool:
        """Split shares by their ``places``; False if none needs it."""
        if not len(self.levels) or len(self.levels) == LONGEST - 1 or (places <= 2 * self.budget).all():
            return False
        self.levels.append(np.where(places > 2 * self.budget, -(-places // self.budget), 1))
        return True

    @property
    def slots(self) -> int:
        """How many shares there are."""
        return int(self.levels[-1].sum()) if self.levels else 0

    def place(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The share of each suffix, -1 for those of other words, and by how many of its first words it is dealt out."""
        n = len(columns[0])
        depth = np.ones(n, np.int64)
        if not self.levels:
            return np.full(n, -1), depth
        slot = np.minimum(np.searchsorted(self.words, columns[0]), len(self.words) - 1)
        inside = self.words[slot] == columns[0]
        by = mix(columns[0], np.full(n, 1, np.uint64))
        for d, shares in enumerate(self.levels):
            by = mix(by, columns[d + 1])
            mine = shares[slot]
            depth = np.where(inside & (mine > 1), d + 2, depth)
            slot = (np.cumsum(shares) - shares)[slot] + (by % mine.astype(np.uint64)).astype(np.int64)
        return np.where(inside, slot, -1), depth


def suffixes(numbers: np.ndarray, piece: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    """Word numbers at each place and the three after it, 0 from the end of the piece or a rare word on; two words at least."""
    n = len(numbers)
    bit = (numbers & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    known = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
    two = np.zeros(n + 3, bool)
    if n > 1:
        two[: n - 1] = (known[:-1] & known[1:]).astype(bool) & (piece[:-1] == piece[1:])
    three = two[:-2] & two[1:-1]
    four = three[:-1] & two[2:-1]
    at = np.flatnonzero(two[:n])
    padded = np.concatenate([numbers, np.zeros(3, np.uint64)])
    return [
        padded[at],
        padded[at + 1],
        np.where(three[at], padded[at + 2], np.uint64(0)),
        np.where(four[at], padded[at + 3], np.uint64(0)),
    ]


def counted(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and how often each occurs (``n`` times where given)."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    sums = np.diff(np.append(at, len(order))) if n is None else np.add.reduceat(n[order], at)
    return [c[at] for c in columns], sums


def subtree(columns: list[np.ndarray], n: np.ndarray, depth: np.ndarray, least: int) -> Iterator[tuple]:
    """Nodes of two words or more with their leaves' total: those that reach ``least``, and those that other shares have leaves of as well.

    ``columns`` are distinct suffixes in order, which are the leaves.
    """
    new = np.zeros(len(n), bool)
    new[:1] = True
    new[1:] = columns[0][1:] != columns[0][:-1]
    for d in range(1, LONGEST):
        new[1:] |= columns[d][1:] != columns[d][:-1]
        at = np.flatnonzero(new)
        total = np.add.reduceat(n, at) if len(at) else n[:0]
        keep = (columns[d][at] != 0) & ((total >= least) | (depth[at] > d + 1))
        at = at[keep]
        yield [c[at] if k <= d else np.zeros(len(at), np.uint64) for k, c in enumerate(columns)], total[keep]


def _share_places(docs: DataFrame, salt: int, bits: np.ndarray, shares: Shares) -> np.ndarray:
    """How many suffixes each share has: a number for each of them."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shares.slots, np.int64)
        for batch in parts:
            for rows in slices(batch, "text"):
                *_, numbers, piece = word_numbers(rows, salt)
                slot, _ = shares.place(suffixes(numbers, piece, bits))
                total += np.bincount(slot[slot >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    out = np.zeros(shares.slots, np.int64)
    for slot, n in docs.mapInArrow(task, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n")).collect():
        out[slot] = n
    return out


def _nodes(docs: DataFrame, salt: int, bits: np.ndarray, shares: Shares, groups: int, least: int) -> DataFrame:
    """``c0 .. c3, a``: phrases that occur ``least`` times."""

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for rows in slices(batch, "text"):
                *_, numbers, piece = word_numbers(rows, salt)
                columns, n = counted(suffixes(numbers, piece, bits))
                if not len(n):
                    continue
                slot, _ = shares.place(columns)
                light = mix(columns[0], np.full(len(n), salt + 1, np.uint64)) % np.uint64(groups)
                group = np.where(slot < 0, light.astype(np.int64), groups + slot)
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.diff(group[order])) + 1
                found = [(int(group[i[0]]), [c[i].tobytes() for c in columns], n[i].astype(np.int64).tobytes()) for i in np.split(order, cuts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g for g, _, _ in found], pa.int64())]
                    + [pa.array([c[k] for _, c, _ in found], pa.binary()) for k in range(LONGEST)]
                    + [pa.array([b for _, _, b in found], pa.binary())],
                    ["place", *WORDS, "a"],
                )

    def build(table: pa.Table) -> pa.Table:
        columns = [np.concatenate([np.frombuffer(b, np.uint64) for b in table[c].to_pylist()]) for c in WORDS]
        n = np.concatenate([np.frombuffer(b, np.int64) for b in table["a"].to_pylist()])
        columns, n = counted(columns, n)
        found = list(subtree(columns, n, shares.place(columns)[1], least))
        whole = [np.concatenate([c[k] for c, _ in found]).view(np.int64) for k in range(LONGEST)]
        return pa.table([pa.array(c) for c in [*whole, np.concatenate([n for _, n in found])]], [*WORDS, "a"])

    blobs = ", ".join(f"{c} binary" for c in WORDS)
    dealt = docs.mapInArrow(deal, f"place bigint, {blobs}, a binary")
    nodes = dealt.groupBy("place").applyInArrow(build, f"{PLACES}, a bigint")
    return nodes.groupBy(*WORDS).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _stretch(a: int, b: int, names: list[str]) -> list[Column]:
    """Words ``a`` to ``b`` of a phrase as three columns, 0 where it has fewer."""
    words = [F.col(WORDS[i]) for i in range(a, b)] + [F.lit(0).cast("bigint")] * 3
    return [w.alias(n) for w, n in zip(words, names)]


def _scored(phrases: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """Adds ``l, r, score`` of the cut with the lowest score."""
    cuts = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("size") == m,
                    F.struct(
                        F.lit(k).alias("k"),
                        *_stretch(0, k, ["l0", "l1", "l2"]),
                        *_stretch(k, m, ["r0", "r1", "r2"]),
                    ),
                )
                for m in range(2, LONGEST + 1)
                for k in range(1, m)
            ]
        )
    )
    rows = phrases.select(*WORDS, "size", "a", F.explode(cuts).alias("cut")).select(*WORDS, "size", "a", "cut.*")
    for side in "lr":
        named = parts.select(*[F.col(f"p{i}").alias(f"{side}{i}") for i in range(3)], F.col("f").alias(side))
        rows = attach(rows, named, [f"{side}{i}" for i in range(3)], size=size, broadcast_bytes=ATTACH_BYTES, salts=4)
    wide = [F.col(c).cast("decimal(20,0)") for c in "lr"]
    rows = rows.withColumn("_top", F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"))
    rows = rows.withColumn("_all", wide[0] + wide[1]).withColumn("score", F.expr("cast(_top div _all as bigint)"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return rows.groupBy(*WORDS, "size", "a").agg(best).select(*WORDS, "size", "a", "best.l", "best.r", "best.score")


def _kept(phrases: DataFrame) -> DataFrame:
    """Phrases but for those inside a longer one that has 80 % of their occurrences."""
    spans = [(m, a, a + k) for m in range(3, LONGEST + 1) for k in range(2, m) for a in range(m - k + 1)]
    names = [f"p{i}" for i in range(3)]
    parts = F.array_compact(F.array(*[F.when(F.col("size") == m, F.struct(*_stretch(a, b, names))) for m, a, b in spans]))
    inside = phrases.select("a", F.explode(parts).alias("part")).select("a", *[f"part.{x}" for x in names])
    most = inside.groupBy(*names).agg(F.max("a").alias("_most"))
    mine = [F.col(f"m.{x}") == F.col(f"x.{c}") for x, c in zip(names, WORDS)]
    joined = phrases.alias("x").join(most.alias("m"), reduce(Column.__and__, mine) & (F.col("x.c3") == 0), "left")
    covered = F.lit(100) * F.col("_most").cast("decimal(20,0)") >= F.lit(80) * F.col("a").cast("decimal(20,0)")
    return joined.where(~F.coalesce(covered, F.lit(False))).select("x.*")


def first_by(df: DataFrame, key: str, order: list[Column], top: int, salt: str, salts: int = 32) -> DataFrame:
    """``df`` with ``rank`` of the first ``top`` rows of each key; shares of a key are cut before its rows meet."""
    share = F.pmod(F.xxhash64(salt), F.lit(salts))
    some = df.withColumn("_share", share)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy(key, "_share").orderBy(*order)))
    some = some.where(F.col("rank") <= top).drop("rank", "_share")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases, all numbers long.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\n\\v\\f\\r]`` into pieces, those at spaces and tabs into words. A
    phrase of two to four words counts from ``a >= least`` occurrences inside pieces on. Cut after its first
    words, it has ``score = floor(2000000 a / (l + r))``, ``l`` and ``r`` being its parts' occurrences; the cut with the lowest
    score counts, of equal ones that with the shorter first part. Phrases inside a longer one with at least 80 % of their
    occurrences go. ``n`` counts the language's words. Phrases are ranked by score, then ``a``, then by their bytes.
    ``budget`` bounds the suffixes that one task holds; it changes no result.
    """
    rows = only(docs, "text", "lang").select(
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")
    )
    salt = 0
    while True:
        vocabulary = _vocabulary(rows, salt)
        if not vocabulary.table.groupBy("id").count().where("count > 1").head(1):
            break
        salt += 1
    frequent = settle_measured(
        vocabulary.table.where(F.col("n") >= least),
        places=F.sum("n"),
    )
    totals = vocabulary.table.groupBy("lang").agg(F.sum("n").alias("n"))
    bits = _frequent_bits(frequent.table, frequent.rows)

    long = frequent.table.where(F.col("n") > budget).select("id", "n").collect()  # at most one of `budget` places each
    shares = Shares(np.array([r["id"] for r in long], np.int64).view(np.uint64), np.array([r["n"] for r in long], np.int64), budget)
    while shares.levels and shares.deepen(_share_places(rows, salt, bits, shares)):
        pass
    groups = -(-(frequent.counts["places"] or 0) // budget) or 1
    size = sum((F.col(c) != 0).cast("int") for c in WORDS)
    nodes = settle(_nodes(rows, salt, bits, shares, groups, least).withColumn("size", size))

    zero = F.lit(0).cast("bigint")
    parts = settle_measured(
        frequent.table.select(F.col("id").alias("p0"), zero.alias("p1"), zero.alias("p2"), F.col("n").alias("f")).unionByName(
            nodes.where("c3 = 0").select(*[F.col(f"c{i}").alias(f"p{i}") for i in range(3)], F.col("a").alias("f"))
        )
    )
    found = _scored(_kept(nodes), parts.table, parts.bytes)
    for i, c in enumerate(WORDS):
        word = frequent.table.select(F.col("id").alias(c), F.col("word").alias(f"w{i}"), *(["lang"] if not i else []))
        found = attach(found, word, [c], "left", size=frequent.bytes, broadcast_bytes=ATTACH_BYTES)
    found = found.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(LONGEST)]))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = attach(first_by(found, "lang", order, top, "phrase"), totals, ["lang"])
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("a", "l", "r", "n", "score")]
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", *numbers)
