"""Which variables feed a variable, from its definitions in source text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# An assignment in a line (optional type, name, operator, right side), the
# names in its right side, quoted text, and words that are never variables.
ASSIGNMENT = (
    r"([A-Za-z_$][A-Za-z0-9_$<>\[\]]*[ \t]+)?([A-Za-z_$][A-Za-z0-9_$]*)[ \t]*"
    r"[-+*/%&|^]?=([^=;][^;]*)"
)
NAME = r"\.?[A-Za-z_$][A-Za-z0-9_$]*[ \t]*\(?"
QUOTED = "\"[^\"]*\"|'[^']*'"
KEYWORDS = ("false", "instanceof", "new", "null", "super", "this", "true")


def assignment_refs(texts: DataFrame) -> DataFrame:
    """Find assignments in ``(file, text)`` and the variables they read.

    Gives occurrences ``(file, line, col, kind, var, refs)``: ``line`` counts
    from 1, ``col`` is the assignment's place in its line. Calls, member names,
    quoted text, keywords and the variable itself are no references. This is a
    pattern on text, not a parser.
    """
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("at", "code"))
    lines = lines.where(F.col("code").contains("="))
    found = F.arrays_zip(
        *[
            F.regexp_extract_all("code", F.lit(ASSIGNMENT), F.lit(group)).alias(name)
            for group, name in ((1, "type"), (2, "var"), (3, "right"))
        ]
    )
    each = lines.select(
        "file", (F.col("at") + 1).alias("line"), F.posexplode(found).alias("nth", "hit")
    )
    names = F.regexp_extract_all(
        F.regexp_replace("hit.right", QUOTED, " "), F.lit(NAME), F.lit(0)
    )
    reads = F.filter(names, lambda n: ~n.startswith(".") & ~n.endswith("("))
    reads = F.transform(reads, lambda n: F.rtrim(F.translate(n, "\t", " ")))
    reads = F.filter(reads, lambda n: ~n.isin(*KEYWORDS) & (n != F.col("hit.var")))
    return each.select(
        "file",
        "line",
        (F.col("nth") + 1).alias("col"),
        F.when(F.trim("hit.type") == "", "assign").otherwise("declare").alias("kind"),
        F.col("hit.var").alias("var"),
        F.array_distinct(reads).alias("refs"),
    )


def parent_map(occurrences: DataFrame) -> DataFrame:
    """Parents of each variable: references of its earliest occurrence.

    Input ``(file, line, col, kind, var, refs)``; at one position an assignment
    goes before a declaration. Output ``(file, var, refs)``.
    """
    rank = F.when(F.col("kind") == "assign", 0).otherwise(1)
    return occurrences.groupBy("file", "var").agg(
        F.min(F.struct("line", "col", rank.alias("rank"), "refs"))["refs"].alias("refs")
    )


def parent_rows(mapping: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(*keys, var, pos, parent)`` rows of a map given as ``(var, refs)``."""
    return mapping.select(*(keys or []), "var", F.posexplode("refs").alias("pos", "parent"))
