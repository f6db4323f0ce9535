"""Dominators and postdominators.

Graphs that fit in a task are worked on whole (``graph_tasks``); what follows holds for larger ones.

A node's dominators lie on every path from the root, so those found along one
breadth-first path are a complete set of candidates: rows grow with nodes times
depth, not with all pairs of nodes. Candidates that some predecessor lacks are
struck out, and each strike is passed on along the edges until none follows.
What stays is the largest set closed under the dominator rule.

Pair tables are ``(graph_id, node, dom)``. A node the roots do not reach is, by
the rule, dominated by every node of its graph; such nodes are given by
:func:`unreached` instead of being multiplied out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import partitioned_by, settle, settle_measured
from .graph_tasks import (
    GRAPH_ROWS,
    control_pairs,
    dominator_pairs,
    each_graph,
    of_graphs,
    parents_of,
    reached,
    split_graphs,
)
from .graphs import COMPACT_EVERY, NODE, SOURCE, edges_distinct, grow, union_all

PAIR = ["graph_id", "node", "dom"]


def _tree_rows(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges, and roots as edges from nowhere, in one settled table."""
    nowhere = F.lit(None).cast("string").alias("src")
    return settle(
        edges_distinct(edges).unionByName(roots.select("graph_id", nowhere, F.col("node").alias("dst")).distinct())
    )


def _dominance(edges: DataFrame, roots: DataFrame, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """Pairs of the nodes reached from ``roots``; edges into a root do not count."""
    small, large = split_graphs(_tree_rows(edges, roots), graph_rows)
    pairs = each_graph(small, dominator_pairs, "node string, dom string")
    if large is None:
        return pairs
    return pairs.unionByName(_table_dominance(of_graphs(edges, large), of_graphs(roots, large)))


def dominance_tree(edges: DataFrame, roots: DataFrame, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """``(graph_id, node, idom)`` of the nodes reached from ``roots``, NULL for those, without a table of pairs
    for graphs of up to ``graph_rows`` rows."""
    small, large = split_graphs(_tree_rows(edges, roots), graph_rows)
    tree = each_graph(small, parents_of, "node string, idom string")
    if large is None:
        return tree
    pairs = settle(_table_dominance(of_graphs(edges, large), of_graphs(roots, large)))
    return tree.unionByName(immediate(pairs.select(*NODE).distinct(), pairs))


def _table_dominance(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``_dominance`` by rounds over tables."""
    roots = settle(roots.select(*NODE).distinct())
    links = settle(
        edges_distinct(edges).join(
            roots.withColumnRenamed("node", "dst"), ["graph_id", "dst"], "left_anti"
        )
    )
    with partitioned_by(links, SOURCE) as kept:
        return _strike(kept, _candidates(kept, roots))


def _candidates(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Every reached node with the nodes on one shortest path to it."""
    newest = settle_measured(roots.withColumn("dom", F.col("node")))
    levels = [newest.table]
    while newest.rows:
        frontier = newest.table.where("node = dom").select("graph_id", F.col("node").alias("src"))
        seen = union_all(levels).where("node = dom").select(*NODE)
        found = (
            frontier.join(links, SOURCE)
            .groupBy("graph_id", F.col("dst").alias("node"))
            .agg(F.min("src").alias("parent"))
            .join(seen, NODE, "left_anti")
        )
        above = newest.table.withColumnRenamed("node", "parent")
        # the parent's own pair also makes the new node's own pair
        own = F.when(F.col("dom") == F.col("parent"), F.array("dom", "node"))
        newest = settle_measured(
            found.join(above, ["graph_id", "parent"]).select(
                *NODE, F.explode(F.coalesce(own, F.array("dom"))).alias("dom")
            )
        )
        levels.append(newest.table)
        if len(levels) >= COMPACT_EVERY:
            levels = [settle(union_all(levels))]
    return settle(union_all(levels))


def _strike(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drop every pair that does not hold for all reached predecessors."""
    reached = pairs.where("node = dom").select("graph_id", F.col("node").alias("src"))
    live = links.join(reached, SOURCE, "left_semi")
    strict = pairs.where("node <> dom")
    claims = live.withColumnRenamed("dst", "node").join(strict, NODE)
    newest = settle_measured(
        claims.join(
            pairs.withColumnRenamed("node", "src"), ["graph_id", "src", "dom"], "left_anti"
        )
        .select(*PAIR)
        .distinct()
    )
    struck = [newest.table]
    while newest.rows:
        passed = (
            newest.table.withColumnRenamed("node", "src")
            .join(links, SOURCE)
            .select("graph_id", F.col("dst").alias("node"), "dom")
            .distinct()
        )
        newest = settle_measured(
            strict.join(passed, PAIR, "left_semi").join(union_all(struck), PAIR, "left_anti")
        )
        struck.append(newest.table)
        if len(struck) >= COMPACT_EVERY:
            struck = [settle(union_all(struck))]
    return pairs.join(union_all(struck), PAIR, "left_anti")


def unreached(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes without any pair: nothing reaches them, every node counts as dominator."""
    reached = pairs.where("node = dom").select(*NODE)
    return nodes.select(*NODE).join(reached, NODE, "left_anti")


def dominators(edges: DataFrame, entries: DataFrame, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """``(graph_id, node, dom)`` for every node reached from the graph's entry.

    Graphs of more than ``graph_rows`` edges and entries are worked on by rounds over tables.
    """
    return _dominance(edges, entries, graph_rows)


def immediate(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(graph_id, node, idom)``: the strict dominator closest to the node, NULL if none.

    A node's dominators form a chain, so the closest one is that with the most
    dominators itself.
    """
    depth = pairs.groupBy("graph_id", F.col("node").alias("dom")).agg(
        F.count(F.lit(1)).alias("depth")
    )
    closest = (
        pairs.where("node <> dom")
        .join(depth, ["graph_id", "dom"])
        .groupBy(*NODE)
        .agg(F.max_by("dom", "depth").alias("idom"))
    )
    return nodes.select(*NODE).join(closest, NODE, "left")


def immediate_dominators(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Immediate dominator of each node; NULL for the entry and for unreached nodes."""
    return immediate(nodes, pairs)


def dominator_tree(idoms: DataFrame) -> DataFrame:
    """``(graph_id, src, dst)``: edges from immediate dominator to node."""
    return idoms.where(F.col("idom").isNotNull()).select(
        "graph_id", F.col("idom").alias("src"), F.col("node").alias("dst")
    )


def dominator_listing(pairs: DataFrame) -> DataFrame:
    """One text line per node with its dominators by name."""
    return pairs.groupBy(*NODE).agg(
        F.concat(
            F.first("node"),
            F.lit(" is dominated by: "),
            F.array_join(F.array_sort(F.collect_list("dom")), " "),
        ).alias("line")
    )


def exits(nodes: DataFrame) -> DataFrame:
    """``(graph_id, node)``: the first node by ``ord`` labelled as a method end."""
    ends = nodes.where(F.col("label").startswith(fixed.METHOD_END))
    return ends.groupBy("graph_id").agg(F.min_by("node", F.struct("ord", "node")).alias("node"))


def graphs_without_exit(nodes: DataFrame) -> DataFrame:
    """Graphs that have no postdominators because no node is a method end."""
    return nodes.select("graph_id").distinct().join(exits(nodes), "graph_id", "left_anti")


def postdominators(nodes: DataFrame, edges: DataFrame, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """``(graph_id, node, dom)`` with ``dom`` a postdominator of ``node``.

    Roots are the exit, whose own successors do not count, and every node
    without successors. Graphs without an exit give no rows.
    """
    return _dominance(*_backward(nodes, edges), graph_rows)


def postdominance_tree(nodes: DataFrame, edges: DataFrame, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """``(graph_id, node, idom)`` of the nodes that :func:`postdominators` has rows for, without its pairs."""
    return dominance_tree(*_backward(nodes, edges), graph_rows)


def _backward(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges turned round, and the ends of each graph that has an exit."""
    ends = settle(exits(nodes))
    ended = nodes.join(ends.select("graph_id"), "graph_id", "left_semi").select(*NODE)
    sources = edges.select("graph_id", F.col("src").alias("node")).distinct()
    sinks = ended.join(sources, NODE, "left_anti").unionByName(ends.select(*NODE))
    backward = edges.join(ends.select("graph_id"), "graph_id", "left_semi").select(
        "graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")
    )
    return backward, sinks


def immediate_postdominators(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Immediate postdominator of each node, NULL where it has none."""
    return immediate(nodes, pairs)


def control_dependence(nodes: DataFrame, edges: DataFrame, graph_rows: int = GRAPH_ROWS) -> DataFrame:
    """``(graph_id, controller, dependent)`` over all methods of each graph.

    Each method is the part of the graph reachable from its start. A branch X
    with successor Y controls the nodes met when walking from Y up the immediate
    postdominators, before X or X's own immediate postdominator. These are
    exactly the postdominators of Y that do not postdominate X. A loop condition also controls the successor that is its
    immediate postdominator. Nodes left without a controller hang under the
    method start.
    """
    parts, links = _methods(nodes, edges, graph_rows)
    ended = settle(exits(parts).select("graph_id"))
    parts = parts.join(ended, "graph_id", "left_semi")
    links = settle(links.join(ended, "graph_id", "left_semi"))

    fan = links.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("n"))
    branches = links.join(fan.where("n >= 2"), ["graph_id", "src"]).drop("n")
    small, large = split_graphs(_tree_rows(*_backward(parts, links)), graph_rows)
    walked = each_graph(small, control_pairs, "controller string, dependent string")
    trees = each_graph(small, parents_of, "node string, idom string")
    if large is not None:
        pairs = settle(_table_dominance(*_backward(of_graphs(parts, large), of_graphs(links, large))))
        walked = walked.unionByName(_table_walks(of_graphs(parts, large), of_graphs(branches, large), pairs))
        trees = trees.unionByName(immediate(pairs.select(*NODE).distinct(), pairs))

    loops = parts.where(F.col("label").startswith(fixed.LOOP_CONDITION)).select(*NODE)
    closing = (
        trees.join(loops, NODE, "left_semi")
        .where(F.col("idom").isNotNull())
        .select("graph_id", F.col("node").alias("src"), F.col("idom").alias("dst"))
        .join(branches, ["graph_id", "src", "dst"], "left_semi")
        .select("graph_id", F.col("src").alias("controller"), F.col("dst").alias("dependent"))
    )
    controlled = settle(walked.unionByName(closing).distinct())

    uncovered = parts.select(*NODE).join(
        controlled.select("graph_id", F.col("dependent").alias("node")), NODE, "left_anti"
    )
    covered = uncovered.where("node <> graph_id.start").select(
        "graph_id", F.col("graph_id.start").alias("controller"), F.col("node").alias("dependent")
    )
    return (
        controlled.unionByName(covered)
        .select("graph_id.graph", "controller", "dependent")
        .distinct()
        .withColumnRenamed("graph", "graph_id")
    )


def _table_walks(parts: DataFrame, branches: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(graph_id, controller, dependent)`` of the walks, by one anti join of postdominator pairs."""
    # nodes of endless loops have no pairs; they still postdominate themselves
    alone = unreached(parts, pairs).withColumn("dom", F.col("node"))
    chains = pairs.unionByName(alone)
    walked = branches.join(chains.withColumnRenamed("node", "dst"), ["graph_id", "dst"]).select(
        "graph_id", F.col("src").alias("controller"), F.col("dom").alias("dependent")
    )
    above = chains.select(
        "graph_id", F.col("node").alias("controller"), F.col("dom").alias("dependent")
    )
    return walked.join(above, ["graph_id", "controller", "dependent"], "left_anti").distinct()


def _methods(nodes: DataFrame, edges: DataFrame, graph_rows: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each method, keyed by graph and method start."""
    starts = nodes.where(F.col("label").startswith(fixed.METHOD_START)).select(*NODE)
    links = edges_distinct(edges)
    members = settle(_members(starts, links, graph_rows))
    ours = settle(links.withColumnRenamed("graph_id", "g"))
    parts = settle(
        members.withColumn("g", F.col("graph_id.graph"))
        .join(
            nodes.select(F.col("graph_id").alias("g"), "node", "label", "ord"), ["g", "node"]
        )
        .select(*NODE, "label", "ord")
    )
    # a method holds every node its members lead to, so both ends are inside
    inside = members.select(
        "graph_id", F.col("graph_id.graph").alias("g"), F.col("node").alias("src")
    ).join(ours, ["g", "src"])
    return parts, settle(inside.select("graph_id", "src", "dst"))


def _members(starts: DataFrame, links: DataFrame, graph_rows: int) -> DataFrame:
    """``(graph_id, node)`` of what each start leads to, ``graph_id`` being graph and start."""
    key = F.struct(F.col("graph_id").alias("graph"), F.col("start")).alias("graph_id")
    small, large = split_graphs(_tree_rows(links, starts), graph_rows)
    members = each_graph(small, reached, "start string, node string").select(key, "node")
    if large is None:
        return members
    ours = settle(of_graphs(links, large).withColumnRenamed("graph_id", "g"))
    begun = of_graphs(starts, large).withColumn("start", F.col("node")).select(key, "node")
    with partitioned_by(ours, ["g", "src"]) as kept:

        def step(newest: DataFrame) -> DataFrame:
            return (
                newest.select("graph_id", F.col("graph_id.graph").alias("g"), F.col("node").alias("src"))
                .join(kept, ["g", "src"])
                .select("graph_id", F.col("dst").alias("node"))
            )

        return members.unionByName(settle(grow(begun, step, NODE)))
