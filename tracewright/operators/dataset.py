"""From text records to a typed, encoded and imputed dataset.

Records are the five text columns plus ``order``: columns that order the rows
totally. Types and codes follow first appearance, so the order has to come from
the data. Missing numbers are NULL inside the engine.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.bags import explode_entries, with_bag
from ..functions.text import binarize_outcome, is_number, to_number
from ..session import Settled, row_bytes, settle, settle_measured
from .joins import LOOKUP_BYTES, attach
from .ranks import exact_median, running_total

MAX_COLUMNS = 5_000
#: Copies of a lookup table too large to broadcast, so that a value that most records hold is not one task's work.
LOOKUP_SALTS = 4


def row_order(order: list[str]) -> Column:
    """One comparable column for the row order."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def parse_covariates(records: DataFrame, order: list[str]) -> DataFrame:
    """``(*order, key, value)`` of every bag; the last pair of a repeated key counts."""
    return with_bag(records.select(*order, "Covariates")).select(
        *order, F.explode("bag").alias("key", "value")
    )


def covariate_types(records: DataFrame, order: list[str]) -> DataFrame:
    """``(key, is_numeric)``: whether a key's first value, by row and place, is a number."""
    entries = explode_entries(records.select(row_order(order).alias("at"), "Covariates"))
    return entries.where("first").groupBy("key").agg(
        F.min_by(is_number(F.col("value")), F.col("at")).alias("is_numeric")
    )


def covariate_values(records: DataFrame, order: list[str]) -> DataFrame:
    """``(key, value, seen_at, kept_at, n)``: the distinct values of each key.

    Where a value was seen first, where it was kept first, and how many records
    keep it. Types, codes and medians all follow from this one pass.
    """
    entries = explode_entries(records.select(row_order(order).alias("at"), "Covariates"))
    return entries.groupBy("key", "value").agg(
        F.min(F.when(F.col("first"), F.col("at"))).alias("seen_at"),
        F.min(F.when(F.col("kept"), F.col("at"))).alias("kept_at"),
        F.count_if("kept").alias("n"),
    )


def encode_first_seen(values: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """``(*keys, value, code)``: codes from 0 in order of first appearance.

    ``values`` holds each value of a key once; ``at`` is where it appears first,
    unique inside a key.
    """
    settled = settle_measured(values)
    numbered = running_total(settled.table, keys, [at], out="_place", rows=settled.rows)
    return numbered.select(*keys, value, (F.col("_place") - 1).cast("int").alias("code"))


@dataclass
class CovariateSummary:
    """What the covariate columns look like: types, medians and code tables."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float | None]
    codes: Settled | None


def types_of(values: DataFrame) -> DataFrame:
    """``(key, is_numeric)`` from the distinct values."""
    return values.groupBy("key").agg(
        F.min_by(is_number(F.col("value")), F.col("seen_at")).alias("is_numeric")
    )


def covariate_codes(values: DataFrame, types: Settled) -> DataFrame:
    """``(key, value, code)`` of the categorical keys."""
    categorical = types.table.where(~F.col("is_numeric")).select("key")
    wanted = attach(values, categorical, ["key"], "left_semi", size=types.bytes)
    kept = wanted.where(F.col("kept_at").isNotNull()).select("key", "value", "kept_at")
    return encode_first_seen(kept, ["key"], "value", "kept_at")


def covariate_medians(values: DataFrame, types: Settled) -> DataFrame:
    """``(key, median)`` of the numeric keys, over all records that hold a number."""
    numeric = types.table.where("is_numeric").select("key")
    wanted = attach(values, numeric, ["key"], "left_semi", size=types.bytes)
    counts = wanted.groupBy("key", to_number(F.col("value")).alias("num")).agg(
        F.sum("n").alias("n")
    )
    return exact_median(counts.where("n > 0"), ["key"], "num", "n")


def _column_names(types: DataFrame) -> list:
    rows = types.orderBy("key").limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} covariate columns")
    return rows


def summarise_covariates(records: DataFrame, order: list[str]) -> CovariateSummary:
    """Collect the column layout of the dataset; its size is the number of columns."""
    values = settle(covariate_values(records, order))
    types = settle_measured(types_of(values))
    columns = _column_names(types.table)
    numeric = [r["key"] for r in columns if r["is_numeric"]]
    categorical = [r["key"] for r in columns if not r["is_numeric"]]
    medians: dict[str, float | None] = dict.fromkeys(numeric)
    if numeric:
        found = covariate_medians(values, types).limit(MAX_COLUMNS).collect()
        medians.update({r["key"]: r["median"] for r in found})
    codes = settle_measured(covariate_codes(values, types)) if categorical else None
    return CovariateSummary(numeric, categorical, medians, codes)


def expand_covariates(records: DataFrame, order: list[str]) -> DataFrame:
    """One column per key beside the records: double, or text for categorical keys."""
    columns = _column_names(covariate_types(records, order))
    bag = F.col("bag")
    return with_bag(records).select(
        *order,
        *fixed.RECORD_COLUMNS,
        *[
            (to_number(bag[r["key"]]) if r["is_numeric"] else bag[r["key"]]).alias(r["key"])
            for r in columns
        ],
    )


def treatment_types(records: DataFrame) -> DataFrame:
    """``(TreatmentVar, is_numeric, missing)``: numeric only when every value is a number."""
    value = F.col("TreatmentVal")
    return records.groupBy("TreatmentVar").agg(
        F.coalesce(F.bool_and(is_number(value)), F.lit(False)).alias("is_numeric"),
        F.count_if(to_number(value).isNull()).alias("missing"),
    )


def variable() -> Column:
    """The variable as a key that is never NULL itself, so that records without a variable are one variable's."""
    return F.struct("TreatmentVar")


def distinct_treatments(records: DataFrame, order: list[str]) -> DataFrame:
    """``(TreatmentVar, TreatmentVal, at, n)``: each variable's distinct values, where first seen and how often.

    Types, codes and medians all follow from this one pass.
    """
    return records.groupBy("TreatmentVar", "TreatmentVal").agg(
        F.min(row_order(order)).alias("at"), F.count(F.lit(1)).alias("n")
    )


def types_of_treatments(values: DataFrame) -> DataFrame:
    """``treatment_types`` from the distinct values."""
    value = F.col("TreatmentVal")
    return values.groupBy("TreatmentVar").agg(
        F.coalesce(F.bool_and(is_number(value)), F.lit(False)).alias("is_numeric"),
        F.sum(F.when(to_number(value).isNull(), F.col("n")).otherwise(0)).alias("missing"),
    )


def treatment_codes(values: DataFrame, types: Settled) -> DataFrame:
    """``(variable, TreatmentVal, code)`` of the categorical treatment variables, ``variable`` holding ``TreatmentVar``."""
    categorical = types.table.where(~F.col("is_numeric")).select(variable().alias("variable"))
    seen = values.where(F.col("TreatmentVal").isNotNull()).select(variable().alias("variable"), "TreatmentVal", "at")
    seen = attach(seen, categorical, ["variable"], "left_semi", size=types.bytes)
    return encode_first_seen(seen, ["variable"], "TreatmentVal", "at")


def treatment_medians(values: DataFrame, types: Settled) -> DataFrame:
    """``(variable, median)`` for numeric variables that miss values."""
    wanted = types.table.where("is_numeric AND missing > 0").select(variable().alias("variable"))
    numbers = values.select(variable().alias("variable"), to_number(F.col("TreatmentVal")).alias("num"), "n")
    numbers = attach(numbers, wanted, ["variable"], "left_semi", size=types.bytes)
    counts = numbers.groupBy("variable", "num").agg(F.sum("n").alias("n"))
    return exact_median(counts, ["variable"], "num", "n")


def treatment_values(records: DataFrame, order: list[str]) -> DataFrame:
    """Records with ``value``: number (imputed by the variable's median) or code, as double.

    Records with a NULL variable are treated like those of any other one.
    """
    numeric = F.col("is_numeric")
    values = settle(distinct_treatments(records, order))
    types = settle_measured(
        types_of_treatments(values),
        coded=F.count_if(~numeric),
        lacking=F.count_if(numeric & (F.col("missing") > 0)),
    )
    facts = types.table.select(variable().alias("variable"), "is_numeric")
    if types.counts["lacking"]:
        facts = facts.join(treatment_medians(values, types), "variable", "left")
    else:
        facts = facts.withColumn("median", F.lit(None).cast("double"))
    limits = {"broadcast_bytes": LOOKUP_BYTES, "salts": LOOKUP_SALTS}
    typed = attach(records.withColumn("variable", variable()), facts, ["variable"], "left", **limits)
    code = F.lit(fixed.MISSING_CODE)
    if types.counts["coded"]:
        codes = treatment_codes(values, types)
        typed = attach(typed, codes, ["variable", "TreatmentVal"], "left", **limits)
        code = F.coalesce("code", code)
    number = F.coalesce(to_number(F.col("TreatmentVal")), F.col("median"))
    value = F.when(numeric, number).otherwise(code.cast("double"))
    return typed.withColumn("value", value).drop("median", "code", "variable")


def _code_bytes(summary: CovariateSummary) -> dict[str, int]:
    """The categorical keys, those with the fewest codes first, each with the size of its codes and all before.

    Lookups are broadcast as far as they fit ``LOOKUP_BYTES`` together, so a key
    with many texts neither fills the driver nor moves the records for the others.
    """
    if not summary.codes or summary.codes.bytes <= LOOKUP_BYTES:
        return dict.fromkeys(summary.categorical, 0)
    table = summary.codes.table
    sizes = table.groupBy("key").agg(F.sum(row_bytes(table)).alias("bytes")).limit(MAX_COLUMNS).collect()
    size_of = dict.fromkeys(summary.categorical, 0) | {r["key"]: r["bytes"] for r in sizes}
    keys = sorted(size_of, key=lambda key: (size_of[key], key))
    return dict(zip(keys, accumulate(size_of[key] for key in keys)))


def training_dataset(
    records: DataFrame, order: list[str], summary: CovariateSummary | None = None
) -> DataFrame:
    """The typed dataset, one row per record, covariate columns sorted by name.

    Columns: ``order``, TestArgs, the covariates, TreatmentVar, TreatmentVal and
    Outcome. Numbers missing everywhere stay NULL.
    """
    summary = summary or summarise_covariates(records, order)
    shaped = with_bag(treatment_values(records, order)).drop("Covariates")
    bag = F.col("bag")
    upto = _code_bytes(summary)
    code_of = {key: f"_code_{i}" for i, key in enumerate(upto)}
    for key, code in code_of.items():
        lookup = summary.codes.table.where(F.col("key") == key).select(
            F.col("value").alias("_text"), F.col("code").alias(code)
        )
        shaped = shaped.withColumn("_text", bag[key])
        limits = {"broadcast_bytes": LOOKUP_BYTES, "salts": LOOKUP_SALTS}
        shaped = attach(shaped, lookup, ["_text"], "left", size=upto[key], **limits).drop("_text")
    columns = {
        key: F.coalesce(to_number(bag[key]), F.lit(summary.medians[key]).cast("double"))
        for key in summary.numeric
    } | {key: F.coalesce(code, F.lit(fixed.MISSING_CODE)) for key, code in code_of.items()}
    return shaped.select(
        *order,
        "TestArgs",
        *[columns[key].alias(key) for key in sorted(columns)],
        "TreatmentVar",
        F.col("value").alias("TreatmentVal"),
        binarize_outcome(F.col("Outcome")).alias("Outcome"),
    )


def covariate_columns(dataset: DataFrame) -> list[str]:
    """Names of the dataset's covariate columns, sorted."""
    return sorted(c for c in dataset.columns if c.startswith(fixed.COVARIATE_PREFIX))


def require_columns(df: DataFrame, names: list[str]) -> None:
    """Raise when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required columns not found: {missing}; available: {df.columns}")


def preview(df: DataFrame, order: list[str], rows: int = 5) -> DataFrame:
    """The first rows in the given order."""
    return df.orderBy(*order).limit(rows)


def median_impute(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Fill missing ``value`` with the exact median of its group; all missing stays missing."""
    number = F.nanvl(value, F.lit(None).cast("double"))
    counts = df.groupBy(*keys, number.alias("num")).agg(F.count(F.lit(1)).alias("n"))
    medians = exact_median(counts, keys, "num", "n")
    return attach(df, medians, keys, "left").withColumn(value, F.coalesce(number, "median")).drop(
        "median"
    )


def dataset_profile(records: DataFrame, order: list[str]) -> DataFrame:
    """``(kind, n, names)``: how many rows, and which keys and variables of each type."""
    covariates = covariate_types(records, order).select(
        F.when(F.col("is_numeric"), "numeric covariate")
        .otherwise("categorical covariate")
        .alias("kind"),
        F.col("key").alias("name"),
    )
    treatments = treatment_types(records).select(
        F.when(F.col("is_numeric"), "numeric treatment")
        .otherwise("categorical treatment")
        .alias("kind"),
        F.col("TreatmentVar").alias("name"),
    )
    rows = records.agg(F.lit("rows").alias("kind"), F.count(F.lit(1)).alias("n")).select(
        "kind", "n", F.lit("").alias("names")
    )
    named = covariates.unionByName(treatments).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"),
    )
    return rows.unionByName(named)


def per_test_aggregate(records: DataFrame, order: list[str]) -> DataFrame:
    """One record per test and candidate variable.

    The value is the mean of the variable's readable values, the outcome that
    of the test's first ``Outcome`` row (0 if none), the covariates those of the
    test's other variables: pairs of the test that the variable itself lacks.
    """
    outcome_row = F.col("TreatmentVar") == "Outcome"
    prefix = len(fixed.COVARIATE_PREFIX) + 1
    pairs = F.transform(
        F.map_entries("bag"),
        lambda e: F.concat(F.substring(e["key"], prefix, 1 << 30), F.lit("="), e["value"]),
    )
    # one row per pair; the record's value is beside the first of them only, so that it counts once
    listed = (
        with_bag(records.where(F.col("TreatmentVar").isNotNull()))
        .select(
            "TestArgs",
            "TreatmentVar",
            "TreatmentVal",
            row_order(order).alias("at"),
            F.posexplode_outer(F.when(~outcome_row, pairs)).alias("place", "pair"),
        )
        .select(
            "TestArgs",
            "TreatmentVar",
            "pair",
            F.when(F.coalesce("place", F.lit(0)) == 0, to_number(F.col("TreatmentVal"))).alias("value"),
            F.when(outcome_row, F.col("at")).alias("at"),
            F.when(outcome_row, binarize_outcome(F.col("TreatmentVal"))).alias("outcome"),
        )
    )
    own = settle(
        listed.groupBy("TestArgs", "TreatmentVar").agg(
            F.avg("value").alias("value"),
            F.collect_set("pair").alias("own"),
            F.min_by("outcome", "at").alias("outcome"),
        )
    )
    # a test has one row of own per variable, no more than the lists it is joined with were made from
    union = own.groupBy("TestArgs").agg(
        F.array_distinct(F.flatten(F.collect_list("own"))).alias("all"),
        F.coalesce(F.max("outcome"), F.lit(0)).alias("outcome"),
    )
    joined = own.where(~outcome_row).drop("outcome").join(union, "TestArgs")
    return joined.select(
        "TestArgs",
        F.array_join(F.array_sort(F.array_except("all", "own")), ";").alias("Covariates"),
        "TreatmentVar",
        F.col("value").alias("TreatmentVal"),
        F.col("outcome").alias("Outcome"),
    )
