"""Record, dataset and ranking files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import format_score
from ..operators.counterfactual import ranking
from .lines import number_rows, with_place

CSV = {"header": True, "quote": '"', "escape": '"', "sep": ","}
TRIM = {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}


def read_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Records of CSV files with ``row_id``, their place in the input.

    The first five columns count, whatever else follows. A quoted field may hold
    newlines; for files known to have none, ``multi_line=False`` lets Spark
    split large files.
    """
    schema = ", ".join(f"{c} string" for c in fixed.RECORD_COLUMNS)
    raw = spark.read.options(**CSV, **TRIM, multiLine=multi_line, enforceSchema=True)
    placed = with_place(raw.schema(schema).csv(path))
    numbered = number_rows(placed).withColumnRenamed("line_no", "row_id")
    return numbered.select(
        "row_id",
        *[
            F.coalesce(c, F.lit("")).alias(c) if c == "Covariates" else F.col(c)
            for c in fixed.RECORD_COLUMNS
        ],
    )


def write_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Append records as CSV; ``mode='overwrite'`` resets the output."""
    _write_csv(records.select(*fixed.RECORD_COLUMNS), path, mode)


def read_dataset(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Typed dataset of CSV files whose header is ``columns``."""
    text = ("TestArgs", "TreatmentVar")
    schema = ", ".join(f"`{c}` {'string' if c in text else 'double'}" for c in columns)
    df = spark.read.options(**CSV, **TRIM).schema(schema).csv(path)
    return df.withColumn("Outcome", F.col("Outcome").cast("int"))


def write_dataset(dataset: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a dataset as CSV with a header; keep working copies in parquet."""
    _write_csv(dataset, path, mode)


def write_ranking(scores: DataFrame, path: str) -> None:
    """Write the ranking as CSV: highest score first, five decimals."""
    names = [F.col("treatment_var"), format_score(F.col("score"))]
    rows = ranking(scores).select(*[c.alias(n) for c, n in zip(names, fixed.RANKING_COLUMNS)])
    _write_csv(rows, path, "overwrite")


def _write_csv(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).options(**CSV, emptyValue="").csv(path)
