"""Covariate bags: ``k=v;k=v`` strings read inside the row, with no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import trim_control


def covariate_entries(bag: Column) -> Column:
    """Array of ``(key, value)`` in text order; pairs without exactly two parts are dropped."""
    pieces = F.transform(F.split(bag, ";"), lambda p: F.rtrim(trim_control(p), F.lit("=")))
    whole = F.filter(pieces, lambda p: (F.instr(p, "=") > 0) & (F.substring_index(p, "=", 2) == p))
    entries = F.transform(
        whole,
        lambda p: F.struct(
            F.concat(
                F.lit(fixed.COVARIATE_PREFIX), trim_control(F.substring_index(p, "=", 1))
            ).alias("key"),
            trim_control(F.substring_index(p, "=", -1)).alias("value"),
        ),
    )
    return F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>"))


def _parsed(records: DataFrame) -> DataFrame:
    # read several times by what follows, so Spark computes it once per row; and not at all where nothing reads it
    return records.withColumn("_entries", covariate_entries(F.col("Covariates")))


def _repeated(start: Column, length: Column, key: Column) -> Column:
    return F.exists(F.slice("_entries", start, length), lambda other: other["key"] == key)


def _is_last(entry: Column, at: Column) -> Column:
    return ~_repeated(at + 2, F.size("_entries"), entry["key"])


def _is_first(entry: Column, at: Column) -> Column:
    return ~_repeated(F.lit(1), at, entry["key"])


def _keys_differ() -> Column:
    return F.size(F.array_distinct(F.col("_entries")["key"])) == F.size("_entries")


def with_bag(records: DataFrame) -> DataFrame:
    """Add ``bag``: ``key -> value`` of the record's covariates; of a repeated key the last."""
    last = F.filter("_entries", _is_last)
    bag = F.map_from_entries(F.when(_keys_differ(), F.col("_entries")).otherwise(last))
    return _parsed(records).withColumn("bag", bag).drop("_entries")


def explode_entries(records: DataFrame) -> DataFrame:
    """One row per pair, as ``key, value`` and the marks ``first`` and ``kept``.

    The first pair of a key in a bag counts for the type of its column, the last
    one is kept as the record's value. Pairs that are neither are left out.
    """

    def mark(entry: Column, first: Column, kept: Column) -> Column:
        return F.struct(entry["key"], entry["value"], first.alias("first"), kept.alias("kept"))

    plain = F.transform("_entries", lambda e: mark(e, F.lit(True), F.lit(True)))
    marked = F.transform("_entries", lambda e, i: mark(e, _is_first(e, i), _is_last(e, i)))
    entries = F.when(_keys_differ(), plain).otherwise(marked)
    rest = [c for c in records.columns if c != "Covariates"]
    return (
        _parsed(records)
        .select(*rest, F.inline(entries).alias("key", "value", "first", "kept"))
        .where("first OR kept")
    )
