"""Work on graphs that are small enough for one task, a graph at a time and many in each task.

Rounds over tables cost a job per level of the deepest graph. Graphs of up to ``GRAPH_ROWS`` rows are instead dealt out whole and
worked on in memory that this bounds; the tables' rounds stay for larger ones, and both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle_measured
from .joins import attach

#: Rows (edges, roots, definitions) of a graph that one task may hold: some 50 MB.
GRAPH_ROWS = 200_000


class Split(NamedTuple):
    """Rows of small graphs, and the ids of the large ones, None if there are none."""

    small: DataFrame
    large: DataFrame | None


def split_graphs(rows: DataFrame, most: int) -> Split:
    """``rows`` of graphs with at most ``most`` of them, and the ids of the others. ``rows`` should be settled."""
    big = settle_measured(rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("graph_id"))
    if not big.rows:
        return Split(rows, None)
    marked = attach(rows, big.table.withColumn("_large", F.lit(True)), ["graph_id"], "left", size=big.bytes)
    return Split(marked.where("_large is null").drop("_large"), big.table)


def of_graphs(rows: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of the graphs in ``large``."""
    return attach(rows, large, ["graph_id"], "left_semi")


def each_graph(rows: DataFrame, work: Callable[[list[tuple]], Iterable[tuple]], result: str) -> DataFrame:
    """What ``work`` makes of each graph's rows (all columns but ``graph_id``), after the graph's id. ``result``: columns as DDL."""
    names = [c for c in rows.columns if c != "graph_id"]
    columns = [c.split() for c in result.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64()}

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        out: list[tuple] = []
        now, held, id_type = None, [], None

        def done() -> None:
            found = list(work(held))
            ids.extend([now] * len(found))
            out.extend(found)

        def batch_of() -> pa.RecordBatch:
            values = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out), columns)]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *values], ["graph_id", *[c for c, _ in columns]])

        for batch in parts:
            id_type = batch.schema.field("graph_id").type
            for graph, *row in zip(*(batch[c].to_pylist() for c in ["graph_id", *names])):
                if held and graph != now:
                    done()
                    held = []
                    if len(out) > 20_000:
                        yield batch_of()
                        ids.clear(), out.clear()
                now = graph
                held.append(tuple(row))
        if held:
            done()
        if out:
            yield batch_of()

    id_ddl = rows.schema["graph_id"].dataType.simpleString()
    dealt = rows.select("graph_id", *names).repartition("graph_id").sortWithinPartitions("graph_id")
    return dealt.mapInArrow(task, f"graph_id {id_ddl}, {result}")


class Tree(NamedTuple):
    """Immediate dominators of the reached nodes; None for roots."""

    parent: dict[str, str | None]
    order: list[str]

    def chain(self, node: str) -> Iterator[str]:
        """The node and its dominators, closest first."""
        at: str | None = node
        while at is not None:
            yield at
            at = self.parent[at]

    def spans(self) -> dict[str, tuple[int, int]]:
        """Numbers of each node's first and last visit: those of a node enclose those of all it dominates."""
        below: dict[str | None, list[str]] = {}
        for node in self.order:
            below.setdefault(self.parent[node], []).append(node)
        found, clock, stack = {}, 0, [(n, False) for n in below.get(None, [])]
        while stack:
            node, left = stack.pop()
            clock += 1
            if left:
                found[node] = (found[node][0], clock)
            else:
                found[node] = (clock, clock)
                stack.append((node, True))
                stack.extend((n, False) for n in below.get(node, []))
        return found


def dominator_tree(successors: dict[str, list[str]], roots: Iterable[str]) -> Tree:
    """Immediate dominators, edges into roots not counted, by walking up from predecessors until all agree."""
    roots = dict.fromkeys(roots)
    number: dict[str, int] = {}
    order: list[str] = []  # after all that a node leads to for the first time
    for root in roots:
        if root in number:
            continue
        number[root] = -1
        stack = [(root, iter(successors.get(root, ())))]
        while stack:
            node, rest = stack[-1]
            for after in rest:
                if after not in number and after not in roots:
                    number[after] = -1
                    stack.append((after, iter(successors.get(after, ()))))
                    break
            else:
                stack.pop()
                number[node] = len(order)
                order.append(node)
    top = len(order)  # above all roots
    before: list[list[int]] = [[] for _ in order]
    for node in order:
        for after in successors.get(node, ()):
            if after in number and after not in roots:
                before[number[after]].append(number[node])
    above = [-1] * top + [top]
    for root in roots:
        above[number[root]] = top
    changed = True
    while changed:
        changed = False
        for at in range(top - 1, -1, -1):
            if order[at] in roots:
                continue
            best = -1
            for p in before[at]:
                if above[p] < 0:
                    continue
                if best < 0:
                    best = p
                while best != p:
                    if best < p:
                        best = above[best]
                    else:
                        p = above[p]
            if above[at] != best:
                above[at], changed = best, True
    parent = {n: None if above[i] in (-1, top) else order[above[i]] for i, n in enumerate(order)}
    return Tree(parent, order)


def lists(pairs: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    return out


def tree_of(rows: list[tuple]) -> Tree:
    """Of a graph's rows ``(src, dst)``, a root being one without ``src``."""
    edges = {(a, b) for a, b in rows if a is not None}
    return dominator_tree(lists(sorted(edges)), sorted({b for a, b in rows if a is None}))


def dominator_pairs(rows: list[tuple]) -> Iterator[tuple[str, str]]:
    """Every reached node with each of its dominators."""
    tree = tree_of(rows)
    return ((node, dom) for node in tree.order for dom in tree.chain(node))


def parents_of(rows: list[tuple]) -> Iterator[tuple[str, str | None]]:
    """Every reached node with its immediate dominator."""
    return iter(tree_of(rows).parent.items())


def control_pairs(rows: list[tuple]) -> Iterator[tuple[str, str]]:
    """Branches and what they control; ``rows`` are edges from a node to one before it, and the ends as roots."""
    tree = tree_of(rows)
    spans = tree.spans()
    after = lists(sorted({(b, a) for a, b in rows if a is not None}))
    for branch, ways in after.items():
        if len(ways) < 2:
            continue
        found = set()
        for way in ways:
            for node in tree.chain(way) if way in spans else [way]:
                if node == branch or (
                    branch in spans and node in spans and spans[node][0] <= spans[branch][0] and spans[branch][1] <= spans[node][1]
                ):
                    if branch in spans:
                        break  # this and all above come after the branch in any case
                    continue
                found.add(node)
        yield from ((branch, node) for node in sorted(found))


def reached_by_any(rows: list[tuple]) -> Iterator[tuple[str]]:
    """Nodes that the starts lead to, each once."""
    after = lists({(a, b) for a, b in rows if a is not None})
    stack = [b for a, b in rows if a is None]
    seen = set(stack)
    while stack:
        for node in after.get(stack.pop(), ()):
            if node not in seen:
                seen.add(node)
                stack.append(node)
    return ((node,) for node in seen)


def reached(rows: list[tuple]) -> Iterator[tuple[str, str]]:
    """Every start with each node that it leads to, itself included; ``rows`` as for dominators, starts as roots."""
    after = lists({(a, b) for a, b in rows if a is not None})
    for start in sorted({b for a, b in rows if a is None}):
        seen, stack = {start}, [start]
        while stack:
            for node in after.get(stack.pop(), ()):
                if node not in seen:
                    seen.add(node)
                    stack.append(node)
        yield from ((start, node) for node in seen)


def holding(rows: list[tuple]) -> Iterator[tuple[str, str, int]]:
    """Which versions of each variable hold after each node: rows ``(src, dst, var, version)``, edges and definitions (at ``dst``).

    The versions of a variable are the bits of a number, in order; a node's bound cuts off the bits below its own
    greatest version, and only bits that are new to a node are passed on.
    """
    after = lists({(a, b) for a, b, var, _ in rows if var is None})
    made: dict[str, dict[str, set[int]]] = {}
    for _, node, var, version in rows:
        if var is not None:
            made.setdefault(var, {}).setdefault(node, set()).add(version)
    for var, places in made.items():
        versions = sorted(set().union(*places.values()))
        bit = {v: i for i, v in enumerate(versions)}
        floor = {node: bit[max(own)] for node, own in places.items()}
        held = {node: sum(1 << bit[v] for v in own) for node, own in places.items()}
        fresh = dict(held)
        while fresh:
            node, bits = fresh.popitem()
            for b in after.get(node, ()):
                low = floor.get(b, 0)
                new = (bits >> low << low) & ~held.get(b, 0)
                if new:
                    held[b] = held.get(b, 0) | new
                    fresh[b] = fresh.get(b, 0) | new
        for node, bits in held.items():
            yield from ((node, var, v) for v in versions if bits >> bit[v] & 1)
