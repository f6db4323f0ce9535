"""The typed dataset in long form: a row for each cell, names in a table of their own.

Any number of covariates may occur, under any names: names that differ only in case, that are long or hold dots are
numbers here and never columns. A cell that a record lacks takes its name's ``fill``, so only what records hold is stored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import binarize_outcome, to_number
from ..session import settle, settle_measured
from .dataset import (
    covariate_codes,
    covariate_medians,
    covariate_values,
    parse_covariates,
    treatment_values,
    types_of,
)
from .joins import attach
from .ranks import running_total


class LongDataset(NamedTuple):
    """``rows``: order columns, TestArgs, TreatmentVar, TreatmentVal, Outcome. ``cells``: order columns, ``no``, ``value``.
    ``names``: ``no`` (from 0, by name), ``key``, ``is_numeric``, ``fill`` (the median, NULL without any number, or the missing code)."""

    rows: DataFrame
    cells: DataFrame
    names: DataFrame


def long_dataset(records: DataFrame, order: list[str]) -> LongDataset:
    """The dataset of text records. Types, codes and medians are those of the wide form.

    All distinct values with their numbers are one table, so every cell is looked up by one join whatever the number of names.
    """
    values = settle(covariate_values(records, order))
    types = settle_measured(types_of(values))
    medians = covariate_medians(values, types)
    named = types.table.join(medians, "key", "left").withColumn(
        "fill", F.when(F.col("is_numeric"), F.col("median")).otherwise(F.lit(float(fixed.MISSING_CODE)))
    )
    names = settle_measured(
        running_total(settle(named.drop("median")), [], ["key"], out="_place", rows=types.rows).select(
            (F.col("_place") - 1).alias("no"), "key", "is_numeric", "fill"
        )
    )
    kept = values.where(F.col("kept_at").isNotNull()).select("key", "value")
    codes = covariate_codes(values, types)
    coded = attach(kept, names.table, ["key"], size=names.bytes).join(codes, ["key", "value"], "left")
    number = F.when(F.col("is_numeric"), F.coalesce(to_number(F.col("value")), F.col("fill"))).otherwise(
        F.col("code").cast("double")
    )
    lookup = settle_measured(coded.select("key", "value", "no", number.alias("_number")))
    cells = attach(parse_covariates(records, order), lookup.table, ["key", "value"], size=lookup.bytes)
    rows = treatment_values(records, order).select(
        *order,
        "TestArgs",
        "TreatmentVar",
        F.col("value").alias("TreatmentVal"),
        binarize_outcome(F.col("Outcome")).alias("Outcome"),
    )
    return LongDataset(rows, cells.select(*order, "no", F.col("_number").alias("value")), names.table)


def gathered(dataset: LongDataset, order: list[str]) -> DataFrame:
    """``rows`` with ``cells``, an array of (no, value) by number: one grouping for all names. Order columns are not NULL."""
    cells = dataset.cells.groupBy(*order).agg(F.array_sort(F.collect_list(F.struct("no", "value"))).alias("cells"))
    none = F.array().cast(cells.schema["cells"].dataType)
    return dataset.rows.join(cells, order, "left").withColumn("cells", F.coalesce("cells", none))


def with_cell(dataset: LongDataset, order: list[str], key: str, out: str) -> DataFrame:
    """``rows`` with the value of one covariate as ``out``, filled where a record lacks it."""
    one = dataset.names.where(F.col("key") == key).select("no", "fill")
    cells = dataset.cells.join(F.broadcast(one.select("no")), "no").select(*order, F.col("value").alias(out))
    fill = one.select(F.col("fill").alias("_fill"))
    joined = dataset.rows.join(cells, order, "left").join(F.broadcast(fill), how="left")
    return joined.withColumn(out, F.coalesce(out, "_fill")).drop("_fill")
