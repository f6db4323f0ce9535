"""Benchmark items inside training documents.

The normalised word windows of all items are a hash set. Each document's windows are
looked up, inside the row, in a bitmap of that set's hashes; what it lets through is compared, word by word, with the
windows themselves, which are broadcast while they are small. Only DataFrame functions.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. An item with fewer words
than a window is one window; one without words is none. Null texts have no words, documents and
items without an id take part (an item without one is counted in no list). Rows that repeat an id are judged one by one.
Other columns of documents stay in ``decontaminate``, whatever their names. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..session import Settled, settle, settle_measured
from .text import ascii_lower, let, only

WIDTH = 10
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same for texts that are not lower-cased.
PLAIN_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Bits for each window in the filter that documents are scanned with, and the most that it has in all (2 MB).
FILTER_SHARE, FILTER_BITS = 64, 1 << 24


def bare_words(text: Column) -> Column:
    """Normalised words, in order; none for a null text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _windows(items: DataFrame, width: int) -> DataFrame:
    """``item_id, size, window``: each item's windows as text, words joined by a space."""
    found = only(items, "item_id", "text").select("item_id", bare_words(F.col("text")).alias("words"))
    found = found.select("item_id", "words", F.least(F.size("words"), F.lit(width)).alias("size")).where("size > 0")
    start = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("start")
    at = found.select("item_id", "size", "words", start)
    return at.select("item_id", "size", F.array_join(F.slice("words", F.col("start"), F.col("size")), " ").alias("window")).distinct()


def _bits(windows: DataFrame, rows: int) -> list[int]:
    """The set's hashes as a bitmap of 64-bit numbers, of bounded length, so that others may share a bit."""
    bits = 1 << 10
    while bits < min(FILTER_BITS, rows * FILTER_SHARE):
        bits *= 2
    hashed = F.pmod(F.xxhash64(F.split("window", " ")), F.lit(bits))
    one = windows.select(hashed.alias("bit")).select((F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("set"))
    out = [0] * (bits // 64)
    for row in one.groupBy("word").agg(F.bit_or("set").alias("set")).collect():
        out[row["word"]] = row["set"]
    return out


def _let_through(words: Column, size: int, bits: Column, length: int) -> Column:
    """Windows of ``size`` words that the bitmap lets through: first word (from 1), size, window."""

    def hashed(start: Column) -> Column:
        return F.pmod(F.xxhash64(F.slice(words, start, F.lit(size))), F.lit(length))

    def known(bit: Column) -> Column:
        return F.getbit(F.get(bits, F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1

    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1)))
    some = F.filter(starts, lambda i: let(hashed(i), known))
    return F.transform(
        F.coalesce(some, F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice(words, i, F.lit(size)), " ").alias("window")),
    )


def _scanned(docs: DataFrame, windows: Settled) -> DataFrame:
    """``docs`` with ``_row``, a number for the row, ``_size``, its words, and ``_maybe``, the windows let through."""
    bits = _bits(windows.table, windows.rows)
    sizes = sorted(r["size"] for r in windows.table.select("size").distinct().collect())
    words = F.col("_words")
    literal = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")
    found = [_let_through(words, size, literal, len(bits) * 64) for size in sizes]
    none = F.expr("cast(array() as array<struct<start:int,size:int,window:string>>)")
    scanned = docs.withColumn("_words", bare_words(F.col("text")))
    scanned = scanned.withColumn("_maybe", F.concat(none, *found)).withColumn("_size", F.size(words))
    return settle(scanned.withColumn("_row", F.monotonically_increasing_id()).drop("_words"))


def _covered(spans: Column) -> Column:
    """How many words the spans, in order, cover."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(1).alias("next"))

    def add(so_far: Column, span: Column) -> Column:
        first, end = F.greatest(so_far["next"], span["start"]), span["start"] + span["size"]
        return F.struct((so_far["n"] + F.greatest(end - first, F.lit(0))).alias("n"), F.greatest(so_far["next"], end).alias("next"))

    return F.aggregate(spans, empty, add, lambda x: x["n"])


def _occurrences(scanned: DataFrame, windows: Settled) -> DataFrame:
    """``_row, start, size, window`` of the windows that documents do have."""
    maybe = scanned.select("_row", F.explode("_maybe").alias("span")).select("_row", "span.*")
    texts = windows.table.select("window").distinct()
    return attach(maybe, texts, ["window"], "left_semi", size=windows.bytes)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """What documents share with benchmark items, one row for each row of ``docs``.

    ``doc_id, n_words, n_hit`` (words inside an occurrence of a window of an item), ``n_items`` (items with such a window),
    ``items_sha256`` (of their ids, sorted as text, joined by commas) and ``contaminated`` (``n_hit > 0``).
    """
    windows = settle_measured(_windows(items, width))
    scanned = _scanned(only(docs, "doc_id", "text"), windows).select("_row", "doc_id", "_size", "_maybe")
    hits = settle(_occurrences(scanned, windows))
    spans = hits.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("spans"))
    spans = spans.select("_row", _covered(F.col("spans")).alias("n_hit"))
    owners = windows.table.where(F.col("item_id").isNotNull()).select("window", "item_id").distinct()
    owned = attach(hits.select("_row", "window").distinct(), owners, ["window"], size=windows.bytes)
    listed = owned.groupBy("_row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = scanned.select("_row", "doc_id", "_size").join(spans, "_row", "left").join(listed, "_row", "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return found.select(
        "doc_id",
        F.col("_size").cast("bigint").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items_found).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, remove: str = "spans") -> DataFrame:
    """``docs`` without what benchmark items have, columns unchanged.

    ``remove="documents"`` drops every document with a hit. ``"spans"`` cuts the words that are hit from the text,
    each with what stands before it, and drops documents that lose their last word.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(remove)
    windows = settle_measured(_windows(items, width))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("`text`").alias("text"))
    scanned = _scanned(whole, windows)
    hits = _occurrences(scanned, windows)
    if remove == "documents":
        return scanned.join(hits.select("_row").distinct(), "_row", "left_anti").select("_doc.*")
    hit = F.explode(F.expr("sequence(start, start + size - 1)")).alias("at")
    at = hits.select("_row", hit).distinct().groupBy("_row").agg(F.collect_set("at").alias("_at"))
    found = scanned.join(at, "_row", "left").where(F.col("_at").isNull() | (F.size("_at") < F.col("_size")))
    gaps = F.regexp_extract_all(F.col("text"), F.lit(f"({PLAIN_GAP})"), F.lit(1))
    words = F.array_remove(F.split("text", PLAIN_GAP), "")
    leads = F.col("text").rlike(f"^{PLAIN_GAP}").cast("int")
    cut = _cut(words, gaps, leads, F.array_sort("_at"))
    text = F.when(F.col("_at").isNull(), F.col("text")).otherwise(cut)
    columns = [text.alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    return found.select(*columns)


def _cut(words: Column, gaps: Column, leads: Column, gone: Column) -> Column:
    """The text of the words that stay: stretches between the numbers in ``gone``, each word after the gap before it.

    Gap ``i + leads - 1`` (from 1) stands before word ``i``; a last gap may follow.
    """
    n = F.size(words)
    edges = F.concat(F.array(F.lit(0)), gone, F.array(n + 1))
    starts = F.slice(edges, 1, F.size(edges) - 1)

    def stretch(after: Column, k: Column) -> Column:
        first, last = after + 1, F.get(edges, k + 1) - 1

        def one(i: Column) -> Column:
            gap = F.when(i + leads - 1 >= 1, F.get(gaps, (i + leads - 2).cast("int"))).otherwise(F.lit(""))
            return F.concat(gap, F.get(words, (i - 1).cast("int")))

        return F.when(last >= first, F.array_join(F.transform(F.sequence(first, last), one), "")).otherwise(F.lit(""))

    trailing = F.when(F.size(gaps) >= n + leads, F.get(gaps, (n + leads - 1).cast("int"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.transform(starts, stretch), ""), trailing)
