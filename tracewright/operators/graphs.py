"""Operators on many graphs at once.

Nodes are ``(graph_id, node, label, ord)`` and edges ``(graph_id, src, dst)``.
``graph_id`` may have any comparable type and is part of every key, so a graph
is spread over tasks by its nodes and never gathered in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import escape_dot, normalise_label, trim_control
from ..session import partitioned_by, settle, settle_measured
from .graph_tasks import GRAPH_ROWS, each_graph, of_graphs, reached_by_any, split_graphs

NODE = ["graph_id", "node"]
SOURCE = ["graph_id", "src"]
COMPACT_EVERY = 16


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union of tables with the same columns."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def edges_distinct(edges: DataFrame) -> DataFrame:
    """Each edge once."""
    return edges.select("graph_id", "src", "dst").distinct()


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, node, predecessors, successors)``, sorted arrays, empty when isolated.

    Both sides are grouped together: one shuffle instead of two joins.
    """
    none = F.lit(None).cast("string")
    ends = union_all(
        [
            nodes.select(*NODE, none.alias("before"), none.alias("after")),
            edges.select("graph_id", F.col("dst").alias("node"), F.col("src").alias("before"), none.alias("after")),
            edges.select("graph_id", F.col("src").alias("node"), none.alias("before"), F.col("dst").alias("after")),
        ]
    )
    return ends.groupBy(*NODE).agg(
        F.array_sort(F.collect_set("before")).alias("predecessors"),
        F.array_sort(F.collect_set("after")).alias("successors"),
    )


def branch_nodes(edges: DataFrame) -> DataFrame:
    """Nodes with two or more distinct successors."""
    return (
        edges_distinct(edges)
        .groupBy("graph_id", F.col("src").alias("node"))
        .agg(F.count(F.lit(1)).alias("n_successors"))
        .where("n_successors >= 2")
    )


def terminal_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose label starts with return or throw, or that have no outgoing edge."""
    named = F.lower(trim_control(F.col("label"))).rlike(fixed.TERMINAL_LABEL)
    sources = edges.select("graph_id", F.col("src").alias("node"), F.lit(1).alias("leaves"))
    joined = nodes.join(sources.distinct(), NODE, "left")
    return joined.where(named | F.col("leaves").isNull()).select(*NODE, "label")


def virtual_entry(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add one entry node per graph, with an edge to every method start."""
    return _with_entry_node(nodes), union_all(
        [
            edges.select("graph_id", "src", "dst"),
            _method_starts(nodes).select(
                "graph_id", F.lit(fixed.VIRTUAL_ENTRY_ID).alias("src"), F.col("node").alias("dst")
            ),
        ]
    ).distinct()


def _method_starts(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("label").startswith(fixed.METHOD_START))


def _with_entry_node(nodes: DataFrame) -> DataFrame:
    entry = nodes.groupBy("graph_id").agg((F.max("ord") + 1).alias("ord"))
    return nodes.select(*NODE, "label", "ord").unionByName(
        entry.select(
            "graph_id",
            F.lit(fixed.VIRTUAL_ENTRY_ID).alias("node"),
            F.lit(fixed.VIRTUAL_ENTRY_LABEL).alias("label"),
            "ord",
        )
    )


def call_site_edges(nodes: DataFrame) -> DataFrame:
    """Edges into the method starts of each graph.

    ``main`` hangs under the virtual entry; another method under the first node,
    by ``ord``, whose label contains its name and an opening bracket, and under
    the virtual entry when there is none. The text ending at each bracket is cut
    into all suffixes as long as a method name, which turns "contains" into an
    equal-key join.
    """
    names = _method_starts(nodes).select(
        "graph_id",
        "node",
        trim_control(F.substring("label", len(fixed.METHOD_START) + 1, 1 << 30)).alias("name"),
    )
    longest = names.agg(F.coalesce(F.max(F.length("name")), F.lit(0))).first()[0]
    pieces = F.split("label", r"\(")
    # all text before the i-th bracket
    heads = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 1),
        lambda i: F.array_join(F.slice(pieces, 1, i), "("),
    )
    calling = (
        nodes.where(F.col("label").contains("("))
        .select("graph_id", "node", "ord", F.explode(heads).alias("head"))
        .withColumn(
            "length", F.explode(F.sequence(F.lit(0), F.least(F.length("head"), F.lit(longest))))
        )
    )
    called = calling.select(
        "graph_id",
        F.expr("right(head, length)").alias("name"),
        "node",
        "ord",
    )
    sites = called.groupBy("graph_id", "name").agg(F.min_by("node", "ord").alias("site"))
    entry = F.lit(fixed.VIRTUAL_ENTRY_ID)
    source = F.when(F.col("name") == "main", entry).otherwise(F.coalesce("site", entry))
    return names.join(sites, ["graph_id", "name"], "left").select(
        "graph_id", source.alias("src"), F.col("node").alias("dst")
    )


def subgraph_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among ``members``."""
    inside = members.select(*NODE).distinct()
    return edges.join(
        inside.withColumnRenamed("node", "src"), ["graph_id", "src"], "left_semi"
    ).join(inside.withColumnRenamed("node", "dst"), ["graph_id", "dst"], "left_semi")


def grow(seeds: DataFrame, step, keys: list[str]) -> DataFrame:
    """Least fixpoint: repeat ``step`` on the newest rows until nothing new appears.

    Every round's new rows are settled, so the plan stays short and a lost
    executor costs one round's work at most.
    """
    newest = settle_measured(seeds.select(*keys).distinct())
    parts = [newest.table]
    while newest.rows:
        found = step(newest.table).select(*keys).distinct()
        newest = settle_measured(found.join(union_all(parts), keys, "left_anti"))
        parts.append(newest.table)
        if len(parts) >= COMPACT_EVERY:
            parts = [settle(union_all(parts))]
    return union_all(parts)


def reachable(edges: DataFrame, starts: DataFrame, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """``(graph_id, node)`` reachable from ``starts``, the starts included.

    Graphs of more than ``graph_rows`` edges and starts are worked on by rounds over tables.
    """
    nowhere = F.lit(None).cast("string").alias("src")
    begun = starts.select("graph_id", nowhere, F.col("node").alias("dst")).distinct()
    small, large = split_graphs(settle(edges_distinct(edges).unionByName(begun)), graph_rows)
    found = each_graph(small, reached_by_any, "node string")
    if large is None:
        return found
    return found.unionByName(_table_reachable(of_graphs(edges, large), of_graphs(starts, large)))


def _table_reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    with partitioned_by(settle(edges_distinct(edges)), SOURCE) as links:

        def step(newest: DataFrame) -> DataFrame:
            return (
                newest.withColumnRenamed("node", "src")
                .join(links, SOURCE)
                .select("graph_id", F.col("dst").alias("node"))
            )

        return grow(starts, step, NODE)


def dot_lines(nodes: DataFrame, edges: DataFrame, name: str = "CFG") -> DataFrame:
    """Lines of a DOT file per graph: ``(graph_id, section, at, line)`` in writing order."""
    graphs = nodes.select("graph_id").distinct()
    edge_rows = edges_distinct(edges)
    label = escape_dot(normalise_label(F.col("label")))
    return union_all(
        [
            graphs.select(
                "graph_id",
                F.lit(0).alias("section"),
                F.lit("").alias("at"),
                F.lit(f"digraph {name} {{").alias("line"),
            ),
            nodes.select(
                "graph_id",
                F.lit(1).alias("section"),
                F.col("node").alias("at"),
                F.format_string('  "%s" [label="%s"];', "node", label).alias("line"),
            ),
            edge_rows.select(
                "graph_id",
                F.lit(2).alias("section"),
                F.concat_ws(" ", "src", "dst").alias("at"),
                F.format_string('  "%s" -> "%s";', "src", "dst").alias("line"),
            ),
            graphs.select(
                "graph_id",
                F.lit(3).alias("section"),
                F.lit("").alias("at"),
                F.lit("}").alias("line"),
            ),
        ]
    )
