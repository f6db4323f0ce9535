"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle_measured


def _large(links: DataFrame) -> DataFrame:
    """Hang each node's greater neighbours on its least one."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Hang each node, and its smaller neighbours, on the least of them; ``a`` is greater than ``b``."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links``, whose two columns are ids of linked nodes.

    The component is named by its smallest id. Each round writes a table below the shared folder; rounds grow
    with the logarithm of the nodes. Null ids and links of a node with itself are left out; no links give no rows.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns)
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b))
    state = None
    while True:
        done = settle_measured(_small(_large(now)), digest=F.bit_xor(F.xxhash64("a", "b")))
        now, new = done.table, (done.rows, done.counts["digest"])
        if new == state or not done.rows:
            break
        state = new
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("b", "b"))
