"""Scalar rules on text: trimming, numbers, outcomes, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

CONTROL = "".join(map(chr, range(0x21)))


def trim_control(text: Column) -> Column:
    """Strip every character up to U+0020 from both ends, not only spaces."""
    return F.btrim(text, F.lit(CONTROL))


def is_number(text: Column) -> Column:
    """True for decimals, exponents, ``NaN`` and ``[+-]Infinity`` (outer blanks allowed)."""
    return trim_control(text).rlike(fixed.NUMBER)


def to_number(text: Column) -> Column:
    """Double value, NULL when the text is no number or is ``NaN``."""
    trimmed = trim_control(text)
    return F.when(trimmed.rlike(fixed.PRESENT_NUMBER), trimmed.try_cast("double"))


def parse_numeric(text: Column) -> Column:
    """Number with ``true``/``false`` read as 1 and 0; NULL when unreadable."""
    word = F.lower(trim_control(text))
    return F.when(word == "true", 1.0).when(word == "false", 0.0).otherwise(to_number(text))


def parse_int(text: Column) -> Column:
    """32-bit integer, NULL when the text is not one."""
    trimmed = trim_control(text)
    return F.when(trimmed.rlike(fixed.INTEGER), trimmed.try_cast("int"))


def binarize_outcome(text: Column) -> Column:
    """1 for the positive outcome words, 0 for everything else including NULL."""
    word = trim_control(F.lower(text))
    return F.coalesce(word.isin(*fixed.POSITIVE_OUTCOMES), F.lit(False)).cast("int")


def csv_escape(field: Column) -> Column:
    """Quote a field that holds a comma, a quote or a newline; NULL becomes empty."""
    quoted = F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(field.isNull(), "").when(field.rlike('[,"\n]'), quoted).otherwise(field)


def normalise_label(label: Column) -> Column:
    """Single-line node label without outer blanks; NULL becomes empty."""
    return F.coalesce(trim_control(F.replace(label, F.lit("\n"), F.lit(" "))), F.lit(""))


def escape_dot(label: Column) -> Column:
    """Backslash before double quotes and round brackets."""
    return F.regexp_replace(label, r'(["()])', r"\\$1")


def args_string(args: Column) -> Column:
    """``[a, b]`` form of an argument list."""
    return F.concat(F.lit("["), F.array_join(args, ", ", "null"), F.lit("]"))


def format_score(score: Column) -> Column:
    """Score with five decimals."""
    return F.format_string(fixed.SCORE_FORMAT, score)


def base_name(name: Column) -> Column:
    """Variable name without its version suffix."""
    return F.regexp_replace(name, fixed.VERSION_SUFFIX, "")


def name_version(name: Column, var: Column) -> Column:
    """Version of ``var`` in a name ``var_v`` or ``var_v_w``, NULL for other names."""
    head = F.concat(var, F.lit("_"))
    tail = F.when(name.startswith(head), F.substring(name, F.length(head) + 1, F.length(name)))
    return F.when(
        tail.rlike("^[0-9]+(_[0-9]+)?$"), F.substring_index(tail, "_", 1).try_cast("bigint")
    )
