"""Text lines with their place in the input, without reading it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import attach

PLACE = ["file", "block", "at"]


def with_place(df: DataFrame) -> DataFrame:
    """Add ``file, block, at``: full path, split and position in the split of each row."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, file, block, at)`` of all text files below ``path``."""
    return with_place(spark.read.text(path)).withColumnRenamed("value", "line")


def number_rows(placed: DataFrame, marker: str | None = None) -> DataFrame:
    """Replace the place columns by ``line_no`` and, with ``marker``, ``run_no``.

    ``line_no`` counts rows from 1 over files in the order of their paths. ``run_no`` counts
    the rows before this one for which ``marker`` holds. Rows are counted inside
    their split, which the reader bounds, and shifted by the totals of the
    earlier splits; only one total per split is ordered globally.
    """
    split = Window.partitionBy("file", "block").orderBy("at")
    mark = F.expr(f"CAST({marker} AS BIGINT)") if marker else F.lit(0).cast("bigint")
    counted = placed.withColumn("_mark", mark)
    totals = counted.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_mark").alias("marks")
    )
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        "file",
        "block",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("marks").over(earlier), F.lit(0)).alias("_marks"),
    )
    upto = split.rowsBetween(Window.unboundedPreceding, 0)
    numbered = attach(counted, shifts, ["file", "block"]).withColumns(
        {
            "line_no": F.row_number().over(split) + F.col("_rows"),
            "run_no": F.sum("_mark").over(upto) - F.col("_mark") + F.col("_marks"),
        }
    )
    dropped = [*PLACE, "_mark", "_rows", "_marks"] + ([] if marker else ["run_no"])
    return numbered.drop(*dropped)
