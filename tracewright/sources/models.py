"""The model store: one parquet table for all variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.models import MODEL_SCHEMA


def save_models(models: DataFrame, path: str) -> None:
    """Replace the stored models."""
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """Stored models."""
    return spark.read.schema(MODEL_SCHEMA).parquet(path)
