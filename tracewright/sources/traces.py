"""Trace logs: ``name = value`` lines, runs closed by a separator line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from .lines import number_rows, read_lines

TRACE_SCHEMA = "run_id bigint, seq bigint, line string"


def log_lines(values: DataFrame) -> DataFrame:
    """``(run_id, seq, line)`` of logged ``(run_id, seq, var, value)``; NULL prints as null."""
    value = F.coalesce(F.col("value").cast("string"), F.lit("null"))
    return values.select("run_id", "seq", F.concat("var", F.lit(" = "), value).alias("line"))


def split_runs(lines: DataFrame) -> DataFrame:
    """``(run_id, seq, line)`` of placed lines: runs numbered from 0, separators removed."""
    marker = f"line = '{fixed.SEPARATOR_LINE}'"
    return (
        number_rows(lines, marker)
        .where(F.col("line") != fixed.SEPARATOR_LINE)
        .select(F.col("run_no").alias("run_id"), F.col("line_no").alias("seq"), "line")
    )


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace of a log: a file, or a folder whose files continue each other in name order."""
    return split_runs(read_lines(spark, path))


def write_trace(trace: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write a trace as log files in run order, each run closed by the separator.

    Files are ranges of (run, position), so a long run continues in the next
    file instead of filling one task.
    """
    closing = trace.groupBy("run_id").agg(F.max("seq").alias("seq")).select(
        "run_id", "seq", F.lit(fixed.SEPARATOR_LINE).alias("line"), F.lit(1).alias("closing")
    )
    lines = trace.select("run_id", "seq", "line", F.lit(0).alias("closing")).unionByName(closing)
    files = max(1, -(-lines.count() // rows_per_file))
    place = ["run_id", "seq", "closing"]
    (
        lines.repartitionByRange(files, *place)
        .sortWithinPartitions(*place)
        .select("line")
        .write.mode("overwrite")
        .text(path)
    )
