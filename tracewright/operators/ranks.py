"""Exact positions and medians inside groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle, settle_measured
from .joins import attach

WINDOW_ROWS = 1_000_000


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    weight: Column | None = None,
    out: str = "upto",
    *,
    rows: int | None = None,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add ``out``: the sum of ``weight`` from the group's first row to this one.

    ``order`` must be unique inside a group. Without ``weight`` the result is
    the row number. When no group exceeds ``window_rows`` this is one window;
    otherwise rows are range-split over ``keys + order``, summed inside each
    piece, and shifted by the total of the pieces before. Both are exact. ``rows``
    is the row count when it is known. ``df`` is read more than once, so pass a
    settled table when it is dear to compute.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight
    biggest = rows
    if rows is None or rows > window_rows:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        biggest, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    if not biggest or biggest <= window_rows:
        frame = Window.partitionBy(*keys).orderBy(*order)
        frame = frame.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(weight).over(frame))

    pieces = math.ceil(rows / window_rows) + 1
    ranged = settle(
        df.withColumn("_weight", weight)
        .repartitionByRange(pieces, *keys, *order)
        .withColumn("_piece", F.spark_partition_id())
    )
    totals = ranged.groupBy(*keys, "_piece").agg(F.sum("_weight").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_piece")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        *keys, "_piece", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        _attach_null_safe(ranged, shift, [*keys, "_piece"])
        .withColumn(out, F.sum("_weight").over(inside) + F.col("_shift"))
        .drop("_weight", "_piece", "_shift")
    )


def _attach_null_safe(fact: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """``attach`` whose keys may be NULL: NULL is moved to a flag beside the key."""
    flags = {f"_null_{c}": F.col(c).isNull() for c in on}
    renamed = dim.withColumns(flags).withColumnsRenamed({c: f"_key_{c}" for c in on})
    defaults = {f"_key_{c}": _filled(dim, c) for c in on}
    left = fact.withColumns({**flags, **defaults})
    right = renamed.withColumns({f"_key_{c}": _filled(dim, c, f"_key_{c}") for c in on})
    names = [*flags, *defaults]
    return attach(left, right, names).drop(*names)


def _filled(df: DataFrame, column: str, source: str | None = None) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.StructType):  # never NULL as a key
        return F.col(source or column)
    zero = F.lit("" if kind.simpleString() == "string" else 0).cast(kind)
    return F.coalesce(F.col(source or column), zero)


def exact_median(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """Exact median per group of ``value`` occurring ``n`` times, NULLs ignored.

    An even count gives the mean of the two middle values. The input is one row
    per distinct value; groups are never gathered into one aggregate buffer.
    """
    present = settle_measured(counts.where(F.col(value).isNotNull()).select(*keys, value, n))
    totals = present.table.groupBy(*keys).agg(F.sum(n).alias("_all"))
    upto = running_total(present.table, keys, [value], F.col(n), "_upto", rows=present.rows)
    placed = attach(upto, totals, keys)
    below = F.col("_upto") - F.col(n)

    def holds(position: Column) -> Column:
        return F.max(F.when((below < position) & (position <= F.col("_upto")), F.col(value)))

    lower = F.expr("(_all + 1) div 2")
    upper = F.expr("_all div 2 + 1")
    return placed.groupBy(*keys).agg(((holds(lower) + holds(upper)) / 2).alias("median"))
