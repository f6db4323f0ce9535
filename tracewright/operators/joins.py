"""Joins of a large table with a smaller one, chosen by the measured size."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle_measured

BROADCAST_BYTES = 64 * 1024 * 1024
#: For the tables that one plan looks values up in, together: the driver holds all of them at once.
LOOKUP_BYTES = BROADCAST_BYTES // 8
SALTS = 16


def row_salt(df: DataFrame, salts: int) -> Column:
    """Salt from the row's content, so a task that runs again salts alike."""
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    return F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")


def attach(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    *,
    size: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``fact`` with ``dim`` on equal columns; ``how`` is inner, left or left_semi.

    ``dim`` is settled and measured first; ``size`` gives the measured size of
    the settled table it is cut from instead. Up to ``broadcast_bytes`` it is
    broadcast and ``fact`` is not shuffled; above, each ``dim`` row is copied
    once per salt and ``fact`` rows spread over the salts, so a key that holds
    most of ``fact`` still uses many tasks.
    """
    if size is None:
        dim, _, size, _ = settle_measured(dim)
    if size <= broadcast_bytes:
        return fact.join(F.broadcast(dim), on, how)
    return salted_join(fact, dim, on, how, salts)


def salted_join(
    fact: DataFrame, dim: DataFrame, on: list[str], how: str, salts: int = SALTS
) -> DataFrame:
    """Shuffle join with the keys of ``fact`` split over ``salts``; rows without a key, which match nothing, go anywhere."""
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lacking = functools.reduce(operator.or_, [F.col(c).isNull() for c in on])
    salt = F.when(lacking, row_salt(fact, (1 << 31) - 1)).otherwise(row_salt(fact, salts))
    spread = fact.withColumn("_salt", salt)
    # asked for by name, else Spark may broadcast what is small on disk only
    return spread.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")
