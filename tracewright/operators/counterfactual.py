"""How much the predicted outcome moves when a variable is set to other values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_score, parse_numeric
from ..session import settle_measured
from .dataset import covariate_columns, require_columns
from .forests import counted, points_of
from .joins import attach
from .models import CONSTANT, LOGISTIC, covariate_means, feature_rows
from .ranks import running_total


def coerce_rows(raw: DataFrame) -> DataFrame:
    """Dataset whose treatment, outcome and covariates were read as text, as numbers.

    A repeated header line is skipped; unreadable numbers become NULL.
    """
    require_columns(raw, ["TreatmentVar", "TreatmentVal", "Outcome"])
    texts = [c for c in raw.columns if c in ("TreatmentVal", "Outcome", *covariate_columns(raw))]
    rows = raw.where(~F.col("TreatmentVar").eqNullSafe("TreatmentVar"))
    return rows.withColumns({c: parse_numeric(F.col(f"`{c}`").cast("string")) for c in texts})


def representative_values(dataset: DataFrame) -> DataFrame:
    """``(treatment_var, reps)``: the values each variable is set to.

    0 and 1 for a variable that only takes these; otherwise all values when
    there are up to two, else the smallest, the upper middle of the distinct
    values and the largest. Missing values are no representatives.
    """
    settled = settle_measured(
        dataset.where(F.col("TreatmentVal").isNotNull())
        .select(
            F.col("TreatmentVar").alias("treatment_var"),
            F.col("TreatmentVal").cast("double").alias("v"),
        )
        .distinct()
    )
    values = settled.table
    facts = values.groupBy("treatment_var").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.bool_and(F.col("v").isin(0.0, 1.0)).alias("switch"),
    )
    placed = running_total(values, ["treatment_var"], ["v"], out="place", rows=settled.rows)
    middle = attach(placed, facts, ["treatment_var"]).where(F.expr("place = n div 2 + 1"))
    reps = (
        F.when(F.col("switch"), F.array(F.lit(0.0), F.lit(1.0)))
        .when(F.col("n") >= 3, F.array("low", "v", "high"))
        .when(F.col("n") == 2, F.array("low", "high"))
        .otherwise(F.array("low"))
    )
    return middle.select("treatment_var", reps.alias("reps"))


def counterfactual_grid(dataset: DataFrame, reps: DataFrame) -> DataFrame:
    """Every row once per representative value of its variable, in ``rep``."""
    rows = dataset.withColumn("treatment_var", F.col("TreatmentVar"))
    return (
        attach(rows, reps, ["treatment_var"])
        .withColumn("rep", F.explode("reps"))
        .drop("reps", "treatment_var")
    )


def _parameters(dataset: DataFrame, models: DataFrame, reps: DataFrame) -> DataFrame:
    """One row per variable with a model: coefficients in dataset order, means, reps."""
    names = covariate_columns(dataset)
    coef = F.map_from_arrays("features", "coef")
    aligned = models.select(
        "treatment_var",
        "kind",
        "const_class",
        "intercept",
        F.when(
            F.col("coef").isNotNull(),
            F.array(*[F.coalesce(coef[c], F.lit(0.0)) for c in (*names, "TreatmentVal")]),
        ).alias("coef"),
    )
    means = covariate_means(dataset)
    packed = means.select(
        "treatment_var",
        F.array(*[F.col(f"`{c}`") for c in names]).cast("array<double>").alias("means"),
    )
    return aligned.join(reps, "treatment_var").join(packed, "treatment_var")


def predicted_class(
    features: list[Column], custom: Callable[[Column], Column] | None = None
) -> Column:
    """Class by model kind; unknown kinds give 0, a failing prediction gives NULL.

    ``features`` are the covariates followed by the treatment value. ``custom``
    predicts for kind ``custom``: a function from a feature array to a class,
    for instance a Pandas UDF.
    """
    # the treatment comes last, so the sum over the covariates is shared by all its values
    score = F.col("intercept")
    for i, value in enumerate(features):
        score = score + F.col("coef")[i] * value
    predicted = F.when(F.col("kind") == CONSTANT, F.col("const_class")).when(
        F.col("kind") == LOGISTIC, F.when(score >= 0, 1).when(score < 0, 0)
    )
    if custom is not None:
        predicted = predicted.when(F.col("kind") == "custom", custom(F.array(*features)))
    return predicted.otherwise(0)


def credit(predicted: Column) -> Column:
    """1.0 for class 1, 0.0 for other classes, 0.5 where the prediction failed."""
    return F.when(predicted.isNull(), 0.5).when(predicted == 1, 1.0).otherwise(0.0)


def _filled(dataset: DataFrame) -> list[Column]:
    return [
        F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.col("means")[i], F.lit(0.0))
        for i, c in enumerate(covariate_columns(dataset))
    ]


def predict_grid(
    dataset: DataFrame,
    models: DataFrame,
    reps: DataFrame | None = None,
    custom: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Rows of the counterfactual grid with ``rep`` and ``predicted``."""
    reps = representative_values(dataset) if reps is None else reps
    rows = dataset.withColumn("treatment_var", F.col("TreatmentVar"))
    grid = attach(rows, _parameters(dataset, models, reps), ["treatment_var"]).withColumn(
        "rep", F.explode("reps")
    )
    predicted = credit(predicted_class([*_filled(dataset), F.col("rep")], custom))
    return grid.select(*[F.col(f"`{c}`") for c in dataset.columns], "rep", predicted.alias("predicted"))


def avg_outcome_by_rep(
    dataset: DataFrame,
    models: DataFrame,
    reps: DataFrame | None = None,
    custom: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(treatment_var, rep, avg_outcome)`` without writing out the grid.

    A row predicts once per representative value in place; only one sum per
    value and variable is shuffled.
    """
    reps = representative_values(dataset) if reps is None else reps
    params = settle_measured(_parameters(dataset, models, reps))
    rows = dataset.withColumn("treatment_var", F.col("TreatmentVar"))
    joined = attach(rows, params.table, ["treatment_var"], size=params.bytes)
    covariates = _filled(dataset)
    slots = [
        credit(predicted_class([*covariates, F.get("reps", F.lit(slot))], custom))
        for slot in range(3)
    ]
    sums = joined.groupBy("treatment_var").agg(
        *[F.avg(slot).alias(f"avg{i}") for i, slot in enumerate(slots)]
    )
    set_to = params.table.select("treatment_var", F.posexplode("reps").alias("slot", "rep"))
    averages = F.array("avg0", "avg1", "avg2")
    return sums.join(set_to, "treatment_var").select(
        "treatment_var", "rep", averages[F.col("slot")].alias("avg_outcome")
    )


def suspiciousness(averages: DataFrame) -> DataFrame:
    """``(treatment_var, score)``: largest minus smallest average outcome."""
    return averages.groupBy("treatment_var").agg(
        (F.max("avg_outcome") - F.min("avg_outcome")).alias("score")
    )


def ranking(scores: DataFrame, exclude_vars: list[str] | None = None) -> DataFrame:
    """Scores, highest first; equal scores by name."""
    if exclude_vars:
        scores = scores.where(~F.col("treatment_var").isin(exclude_vars))
    return scores.orderBy(F.desc("score"), F.asc("treatment_var"))


def ranking_top(scores: DataFrame, rows: int = 10) -> DataFrame:
    """The top of the ranking."""
    return ranking(scores).limit(rows)


def ranking_lines(scores: DataFrame) -> DataFrame:
    """The ranking with the score as text, five decimals."""
    return ranking(scores).select("treatment_var", format_score(F.col("score")).alias("score"))


def score_forest(dataset: DataFrame, forests: dict, reps: DataFrame | None = None) -> DataFrame:
    """``avg_outcome_by_rep`` for random forests, one per named variable.

    Rows whose covariates lie between the same thresholds of a forest are predicted the same, so they are counted and
    predicted once.
    """
    from pyspark.ml.functions import array_to_vector

    known = settle_measured(representative_values(dataset) if reps is None else reps)
    rows = feature_rows(dataset)  # each forest reads its variable's rows once
    width = len(covariate_columns(dataset))
    parts = []
    for var, model in forests.items():
        points = points_of(model)
        own = rows.where(F.col("treatment_var") == var).select("treatment_var", *[f"x{i}" for i in range(width)])
        cells, covariates = counted(own, points and points[:width])
        grid = attach(cells, known.table, ["treatment_var"], size=known.bytes).withColumn("rep", F.explode("reps"))
        grid = grid.withColumn("features", array_to_vector(F.array(*covariates, F.col("rep"))))
        ones = F.sum(F.when(F.col("prediction") == 1, F.col("n")).otherwise(0))
        parts.append(
            model.transform(grid).groupBy("treatment_var", "rep").agg((ones / F.sum("n")).alias("avg_outcome"))
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
