"""From trace lines to one record per run and variable.

A trace is ``(run_id, seq, line)`` with ``seq`` unique inside a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import parse_int, trim_control
from .joins import attach
from .ranks import running_total


def parse_assignments(trace: DataFrame) -> DataFrame:
    """``(run_id, seq, var, value)`` of every line with a ``=``; the first one splits."""
    line = F.col("line")
    cut = F.instr(line, "=")
    return trace.where(
        (cut > 0) & ~trim_control(line).startswith(fixed.SEPARATOR_PREFIX)
    ).select(
        "run_id",
        "seq",
        trim_control(F.substring_index(line, "=", 1)).alias("var"),
        trim_control(F.substring(line, cut + 1, F.length(line))).alias("value"),
    )


def is_core(var: Column) -> Column:
    """False for temporary and debug variables."""
    return ~var.startswith(fixed.TEMP_PREFIX) & ~var.endswith(fixed.DEBUG_SUFFIX)


def core_assignments(assignments: DataFrame) -> DataFrame:
    """Assignments of core variables."""
    return assignments.where(is_core(F.col("var")))


def last_values(assignments: DataFrame) -> DataFrame:
    """Last value and first position of every variable of every run."""
    return assignments.groupBy("run_id", "var").agg(
        F.max_by("value", "seq").alias("value"), F.min("seq").alias("first_seq")
    )


def final_assignments(assignments: DataFrame) -> DataFrame:
    """Last value per run and core variable; ``first_seq`` carries first-seen order."""
    return last_values(core_assignments(assignments))


def covariate_lookup(assignments: DataFrame, parents: DataFrame) -> DataFrame:
    """``(run_id, var, pos, parent, value)``: each parent's last value in the run, or ``N/A``.

    Parents are looked up among all assignments, temporaries included. Runs and
    variables come from the core assignments; variables without parents give no
    row.
    """
    values = last_values(assignments)
    wanted = attach(values.where(is_core(F.col("var"))).select("run_id", "var"), parents, ["var"])
    known = values.select("run_id", F.col("var").alias("parent"), "value")
    return wanted.join(known, ["run_id", "parent"], "left").select(
        "run_id",
        "var",
        "pos",
        "parent",
        F.coalesce("value", F.lit(fixed.MISSING_PARENT)).alias("value"),
    )


def outcome_lines(trace: DataFrame) -> DataFrame:
    """``(run_id, outcome)`` of the runs with an outcome line: the first one's integer, or 0."""
    line = F.col("line")
    marked = trace.where(line.startswith(fixed.OUTCOME_PREFIX) & (F.instr(line, "=") > 0))
    right = F.substring(line, F.instr(line, "=") + 1, F.length(line))
    outcome = F.coalesce(parse_int(right), F.lit(0))
    return marked.groupBy("run_id").agg(F.min_by(outcome, "seq").alias("outcome"))


def run_outcomes(trace: DataFrame) -> DataFrame:
    """``(run_id, outcome)`` of every run, 0 for a run without outcome line."""
    runs = trace.select("run_id").distinct()
    return runs.join(outcome_lines(trace), "run_id", "left").select(
        "run_id", F.coalesce("outcome", F.lit(0)).alias("outcome")
    )


def append_outcomes(trace: DataFrame, status: DataFrame) -> DataFrame:
    """Add to each run its closing outcome line: 1 where ``status.error`` is NULL, else 0.

    ``status`` is ``(run_id, seq, error)`` with the position for the new line.
    """
    closing = status.select(
        "run_id",
        "seq",
        F.concat(
            F.lit(f"{fixed.OUTCOME_PREFIX} = "),
            F.when(F.col("error").isNull(), "1").otherwise("0"),
        ).alias("line"),
    )
    return trace.select("run_id", "seq", "line").unionByName(closing)


def execution_records(
    trace: DataFrame, parents: DataFrame, test_args: DataFrame | None = None
) -> DataFrame:
    """One record per run and core variable.

    Columns: ``run_id, first_seq``, then the five record columns as text.
    ``test_args`` is ``(run_id, TestArgs)``; without it the run id stands in.

    Each variable's last value is sent to the variables it is a parent of, so a
    record and its covariates meet in one grouping by run and variable.
    """
    values = last_values(parse_assignments(trace))
    links = parents.select(F.col("parent").alias("var"), F.col("var").alias("child")).distinct()
    sent = attach(values, links, ["var"]).select(
        "run_id",
        F.col("child").alias("var"),
        F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("bigint").alias("first_seq"),
        F.struct(F.col("var").alias("parent"), F.col("value")).alias("sent"),
    )
    own = values.where(is_core(F.col("var"))).withColumn(
        "sent", F.lit(None).cast(sent.schema["sent"].dataType)
    )
    met = (
        own.unionByName(sent)
        .groupBy("run_id", "var")
        .agg(
            F.max("value").alias("value"),
            F.max("first_seq").alias("first_seq"),
            F.map_from_entries(F.collect_list("sent")).alias("known"),
        )
        .where(F.col("first_seq").isNotNull())
    )
    lists = parents.groupBy("var").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "parent"))), lambda p: p["parent"]
        ).alias("parents")
    )
    bag = F.transform(
        "parents",
        lambda p: F.concat(
            p, F.lit("="), F.coalesce(F.col("known")[p], F.lit(fixed.MISSING_PARENT))
        ),
    )
    listed = attach(met, lists, ["var"], "left").select(
        "run_id",
        "first_seq",
        F.coalesce(F.array_join(bag, ";"), F.lit("")).alias("Covariates"),
        F.col("var").alias("TreatmentVar"),
        F.col("value").alias("TreatmentVal"),
    )
    full = attach(listed, outcome_lines(trace), ["run_id"], "left")
    if test_args is not None:
        full = attach(full, test_args, ["run_id"], "left")
    else:
        full = full.withColumn("TestArgs", F.col("run_id").cast("string"))
    return full.select(
        "run_id",
        "first_seq",
        "TestArgs",
        "Covariates",
        "TreatmentVar",
        "TreatmentVal",
        F.coalesce("outcome", F.lit(0)).cast("string").alias("Outcome"),
    )


def assignment_versions(assignments: DataFrame) -> DataFrame:
    """Number the assignments of each variable in a run from 1, in order."""
    return running_total(assignments, ["run_id", "var"], ["seq"], out="version").withColumn(
        "versioned", F.concat_ws("_", "var", F.col("version").cast("string"))
    )


def success_rate(outcomes: DataFrame) -> DataFrame:
    """``(total, ok, failed, rate)``; the rate in percent is cut to two decimals."""
    ok = F.count_if(F.col("outcome") == 1)
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        ok.alias("ok"),
        (F.count(F.lit(1)) - ok).alias("failed"),
    ).withColumn("rate", F.expr("CASE WHEN total > 0 THEN (ok * 10000 div total) / 100.0D END"))
