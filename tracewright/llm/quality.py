"""Quality rules: counts over words and lines, and divergence from each language's usual text.

Only DataFrame functions. One pass over the text leaves small counts and the short words;
from these come, for each language, the shares of character classes and of its commonest short
words, and the Jensen-Shannon distance of every document from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import attach
from ..session import settle, settle_measured
from .text import let, only, words

#: Classes of the bytes of a text; what is left (lower case, rare signs) is the last class.
CLASSES = ("upper", "digit", "white", "symbol", "mark", "beyond", "other")
#: The characters of some of them, which are one byte each. ``beyond``: all but the first byte of a character.
UPPER, DIGIT, SYMBOL, MARK = "[A-Z]+", "[0-9]+", "[#*$%&|<>]+", "[.,;:?!'\"()-]+"
#: Words of at most so many characters are counted as common words of a language.
SHORT = 6
COMMON = 24
#: Documents below these are not judged on characters, or on words.
MIN_CHARS, MIN_WORDS = 200, 50
#: Greatest Jensen-Shannon distances (0 to 1) from the reference.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.45


def _positive(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two distributions given as arrays of equal length."""

    def part(x, y):
        return _positive((x + y) / 2) - (_positive(x) + _positive(y)) / 2

    return F.sqrt(F.greatest(F.lit(0.0), -_sum(F.zip_with(p, q, part))))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / total)


def measured(docs: DataFrame) -> DataFrame:
    """What one pass over the text gives for each document: counts, ``bytes`` (their sum), the counts of
    ``CLASSES``, and the short words in lower case."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    parts = only(docs, "doc_id", "lang", "text").select("doc_id", "lang", text.alias("text"), words(text).alias("w"))
    return parts.select(
        "doc_id",
        "lang",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        _count(F.col("text"), SYMBOL).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.length("text").cast("bigint").alias("chars"),
        F.octet_length("text").cast("bigint").alias("bytes"),
        _count(F.col("text"), UPPER).cast("bigint").alias("upper"),
        _count(F.col("text"), DIGIT).cast("bigint").alias("digit"),
        _count(F.col("text"), MARK).cast("bigint").alias("mark"),
        F.filter(words(F.lower("text")), lambda x: F.length(x) <= SHORT).alias("short"),
    )


def _classes(total) -> dict[str, Column]:
    """The counts of ``CLASSES`` from columns of ``measured``, each passed through ``total``."""
    n = {c: total(F.col(c)) for c in ("upper", "digit", "mark", "bytes", "chars", "word_chars")}
    n["symbol"], n["white"] = total(F.col("n_symbols")), n["chars"] - n["word_chars"]
    n["beyond"] = n["bytes"] - n["chars"]
    known = n["upper"] + n["digit"] + n["white"] + n["symbol"] + n["mark"] + n["beyond"]
    n["other"] = n["bytes"] - known
    return n


def references(measures: DataFrame) -> DataFrame:
    """A row per named language, however rare: ``ref_lang``, ``ref_classes`` (shares of the classes),
    ``ref_words`` (common words) and ``ref_shares`` (theirs, the last for all others).

    Every document of the language counts. Without one of text, a language has no row.
    """
    measures = measures.where(F.col("lang").isNotNull())
    sums = _classes(F.sum)
    by_lang = measures.groupBy("lang").agg(
        *[sums[c].alias(c) for c in CLASSES], sums["bytes"].alias("bytes"), F.sum("n_words").alias("all_words")
    )
    by_lang = by_lang.where(F.col("bytes") > 0)
    counted = measures.select("lang", F.explode("short").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counted.withColumn("k", F.row_number().over(first)).where(F.col("k") <= COMMON)
    listed = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("t"))
    listed = listed.select(
        F.col("lang").alias("w_lang"), F.col("t.word").alias("ref_words"), F.col("t.n").alias("ref_counts")
    )
    shares = F.transform("ref_counts", lambda n: n / F.col("all_words"))
    return by_lang.join(listed, F.col("lang") == F.col("w_lang"), "left").select(
        F.col("lang").alias("ref_lang"),
        F.array(*[F.coalesce(F.col(c) / F.col("bytes"), F.lit(0.0)) for c in CLASSES]).alias("ref_classes"),
        F.coalesce("ref_words", F.array().cast("array<string>")).alias("ref_words"),
        F.coalesce(let(shares, lambda s: F.concat(s, F.array(1.0 - _sum(s)))), F.array(F.lit(1.0))).alias("ref_shares"),
    )


def repeated_words(found: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in ``found``, the first included."""

    def starts(hashed):
        def marked(s):
            def one(pair, i):
                at = F.get(s, i)
                same = F.coalesce(F.get(s, i - 1)["h"] == at["h"], F.lit(False)) | F.coalesce(
                    F.get(s, i + 1)["h"] == at["h"], F.lit(False)
                )
                return F.when(same, at["i"])

            return F.sort_array(F.filter(F.transform(s, one), lambda x: x.isNotNull()))

        pairs = F.transform(hashed, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return let(F.sort_array(pairs), marked)

    def covered(at):
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(5)), F.lit(5)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def of(w):
        windows = F.transform(
            F.slice(w, 1, F.size(w) - 4),
            lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, 5)]),
        )

        def some(hashed):
            again = F.size(F.array_distinct(hashed)) < F.size(hashed)
            return F.when(again, let(starts(hashed), covered)).otherwise(0)

        return F.when(F.size(w) < 6, 0).otherwise(let(windows, some))

    return let(found, of).cast("bigint")


def _common_counts(short: Column, common: Column, all_words: Column) -> Column:
    """How often each of ``common`` occurs among ``short``, and what is left of ``all_words``."""

    def of(places):
        n = F.size(places)
        counts = F.transform(
            common, lambda _, k: n - F.size(F.array_remove(places, (k + 1).cast("bigint")))
        )
        return F.concat(counts, F.array((all_words - n).cast("int")))

    places = F.filter(F.transform(short, lambda w: F.array_position(common, w)), lambda k: k > 0)
    return let(places, of)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, char_distance, word_distance, kept``.

    ``docs`` has ``doc_id, text, lang``; further columns are left alone. A distance is null where
    the document is too short for it or its ``lang`` is null, and then does not speak against the
    document. A null text counts as empty, and fails for want of words. Repeated rows are judged
    each for itself.
    """
    measures = settle(measured(docs))
    refs = settle_measured(references(measures))
    met = attach(measures.withColumn("ref_lang", F.col("lang")), refs.table, ["ref_lang"], "left", size=refs.bytes)
    known = F.col("ref_classes").isNotNull()
    found = _classes(lambda c: c)
    own = F.array(*[found[c] / F.col("bytes") for c in CLASSES])
    common = let(
        _common_counts(F.col("short"), F.col("ref_words"), F.col("n_words")),
        lambda c: js_distance(_shares(c, F.col("n_words")), F.col("ref_shares")),
    )
    out = met.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.when(known & (F.col("chars") >= MIN_CHARS), js_distance(own, F.col("ref_classes"))).alias("char_distance"),
        F.when(known & (F.col("n_words") >= MIN_WORDS), common).alias("word_distance"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    usual = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (
        F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE
    )
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & usual)
