"""DOT files of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graphs import dot_lines


def write_dot(nodes: DataFrame, edges: DataFrame, path: str, name: str = "CFG") -> None:
    """Write every graph's DOT lines in order, in a folder per graph."""
    place = ["graph_id", "section", "at"]
    (
        dot_lines(nodes, edges, name)
        .repartitionByRange(*place)
        .sortWithinPartitions(*place)
        .select("graph_id", "line")
        .write.mode("overwrite")
        .partitionBy("graph_id")
        .text(path)
    )
