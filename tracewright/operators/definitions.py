"""Versioned variables in node labels, and which of them reach which node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import base_name, name_version
from ..session import partitioned_by, settle
from .graph_tasks import GRAPH_ROWS, each_graph, holding, of_graphs, split_graphs
from .graphs import NODE, SOURCE, edges_distinct, grow

DEFINITION = [*NODE, "var", "version"]


def label_versions(nodes: DataFrame) -> DataFrame:
    """``(graph_id, node, var, version)`` named in labels that contain a ``=``."""
    hits = F.arrays_zip(
        F.regexp_extract_all("label", F.lit(fixed.VERSIONED_NAME), F.lit(1)).alias("var"),
        F.regexp_extract_all("label", F.lit(fixed.VERSIONED_NAME), F.lit(2)).alias("version"),
    )
    return (
        nodes.where(F.col("label").contains("="))
        .select(*NODE, F.explode(hits).alias("hit"))
        .select(*NODE, "hit.var", F.col("hit.version").try_cast("bigint").alias("version"))
        .distinct()
    )


def gen_kill(nodes: DataFrame) -> DataFrame:
    """``(graph_id, node, var, gen, kill_below)``: versions made, and the bound of those ended."""
    return label_versions(nodes).groupBy(*NODE, "var").agg(
        F.array_sort(F.collect_set("version")).alias("gen"),
        F.max("version").alias("kill_below"),
    )


def reaching_definitions(nodes: DataFrame, edges: DataFrame, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """``(graph_id, node, var, version)`` that hold after each node.

    A node passes on what reaches it, without versions below the largest it
    makes of the same variable, and adds its own. Graphs of more than ``graph_rows`` edges and
    definitions are worked on by rounds over tables.
    """
    made = label_versions(nodes)
    nothing = F.lit(None)
    rows = edges_distinct(edges).select(
        "graph_id", "src", "dst", nothing.cast("string").alias("var"), nothing.cast("bigint").alias("version")
    )
    definitions = made.select("graph_id", nothing.cast("string").alias("src"), F.col("node").alias("dst"), "var", "version")
    # a version too long to count is no version
    rows = settle(rows.unionByName(definitions.where(F.col("version").isNotNull())))
    small, large = split_graphs(rows, graph_rows)
    found = each_graph(small, holding, "node string, var string, version bigint")
    if large is None:
        return found
    return found.unionByName(_table_reaching(of_graphs(nodes, large), of_graphs(edges, large)))


def _table_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``reaching_definitions`` by rounds over tables."""
    made = settle(label_versions(nodes).where(F.col("version").isNotNull()))
    bounds = settle(made.groupBy(*NODE, "var").agg(F.max("version").alias("bound")))
    with partitioned_by(settle(edges_distinct(edges)), SOURCE) as links:

        def step(newest: DataFrame) -> DataFrame:
            arriving = (
                newest.withColumnRenamed("node", "src")
                .join(links, SOURCE)
                .select("graph_id", F.col("dst").alias("node"), "var", "version")
                .distinct()
            )
            return arriving.join(bounds, [*NODE, "var"], "left").where(
                "bound IS NULL OR version >= bound"
            )

        return grow(made, step, DEFINITION)


def base_names(names: DataFrame) -> DataFrame:
    """``(name, base)``: names without their version suffix."""
    return names.select("name", base_name(F.col("name")).alias("base"))


def max_versions(names: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, var, version)``: the largest version of each wanted variable, 0 if none.

    ``names`` is ``(*keys, name)``, ``wanted`` is ``(*keys, var)``. A name
    ``x_1_2`` is version 1 of ``x`` and version 2 of ``x_1``, so each name offers
    at most two variables to an equal-key join.
    """
    once = F.regexp_extract("name", "^(.*)_[0-9]+$", 1)
    twice = F.regexp_extract("name", "^(.*)_[0-9]+_[0-9]+$", 1)
    offers = names.select(*keys, "name", F.explode(F.array(once, twice)).alias("var")).where(
        "var <> ''"
    )
    best = (
        offers.select(*keys, "var", name_version(F.col("name"), F.col("var")).alias("version"))
        .groupBy(*keys, "var")
        .agg(F.max("version").alias("version"))
    )
    return wanted.join(best, [*keys, "var"], "left").withColumn(
        "version", F.coalesce("version", F.lit(0))
    )
