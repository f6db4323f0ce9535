"""One outcome model per treatment variable, all fitted in the same jobs.

A model row is ``(treatment_var, kind, const_class, features, coef, intercept)``
with ``features`` the sorted covariate columns followed by the treatment value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import Settled, drop_settled, settle, settle_measured
from .dataset import covariate_columns
from .forests import as_model, bagged_cells, facts_of, grow
from .graphs import union_all
from .joins import attach

CONSTANT = "constant"
LOGISTIC = "logistic"
MODEL_SCHEMA = (
    "treatment_var string, kind string, const_class int, "
    "features array<string>, coef array<double>, intercept double"
)
SUMS_IN_JVM = 300


def class_cardinality(dataset: DataFrame) -> DataFrame:
    """``(treatment_var, n_classes, min_class)`` over the outcomes of each variable."""
    return (
        dataset.where(F.col("TreatmentVar").isNotNull())
        .groupBy(F.col("TreatmentVar").alias("treatment_var"))
        .agg(
            F.count_distinct("Outcome").cast("int").alias("n_classes"),
            F.min("Outcome").alias("min_class"),
        )
    )


def treatment_vars(dataset: DataFrame) -> DataFrame:
    """Distinct treatment variables."""
    return dataset.select(F.col("TreatmentVar").alias("treatment_var")).distinct()


def treatment_counts(dataset: DataFrame) -> DataFrame:
    """Rows per treatment variable."""
    return dataset.groupBy(F.col("TreatmentVar").alias("treatment_var")).agg(
        F.count(F.lit(1)).alias("n")
    )


def constant_models(dataset: DataFrame) -> DataFrame:
    """Models of the variables whose rows all have one outcome."""
    features = F.array(*[F.lit(c) for c in (*covariate_columns(dataset), "TreatmentVal")])
    return class_cardinality(dataset).where("n_classes = 1").select(
        "treatment_var",
        F.lit(CONSTANT).alias("kind"),
        F.col("min_class").cast("int").alias("const_class"),
        features.alias("features"),
        F.lit(None).cast("array<double>").alias("coef"),
        F.lit(None).cast("double").alias("intercept"),
    )


def covariate_means(dataset: DataFrame) -> DataFrame:
    """One row per variable: the mean of each covariate over its values, 0.0 if none."""
    names = covariate_columns(dataset)
    if not names:
        return treatment_vars(dataset)
    return dataset.groupBy(F.col("TreatmentVar").alias("treatment_var")).agg(
        *[
            F.coalesce(F.avg(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))), F.lit(0.0)).alias(c)
            for c in names
        ]
    )


def fill_covariates(dataset: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Replace missing covariates by their variable's mean."""
    names = covariate_columns(dataset)
    means = covariate_means(dataset) if means is None else means
    renamed = means.withColumnsRenamed({c: f"_mean_{c}" for c in names})
    filled = {
        c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.col(f"`_mean_{c}`"))
        for c in names
    }
    # as fields, so that rows without a variable find the means of theirs
    keyed = renamed.withColumn("_variable", F.struct("treatment_var")).drop("treatment_var")
    rows = dataset.withColumn("_variable", F.struct(F.col("TreatmentVar").alias("treatment_var")))
    joined = attach(rows, keyed, ["_variable"])
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in dataset.columns])


def feature_rows(dataset: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """``(treatment_var, y, x0, x1, ..)``: covariates, missing ones filled, then the treatment.

    Rows without treatment are left out.
    """
    return _treated(fill_covariates(dataset, means), [*covariate_columns(dataset), "TreatmentVal"])


def label_rows(dataset: DataFrame) -> DataFrame:
    """``(treatment_var, y)`` of ``feature_rows``, for which no covariate need be filled."""
    return _treated(dataset, [])


def _treated(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.where(
        F.col("TreatmentVar").isNotNull() & F.col("TreatmentVal").isNotNull()
    ).select(
        F.col("TreatmentVar").alias("treatment_var"),
        F.col("Outcome").cast("double").alias("y"),
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names)],
    )


def feature_array(rows: DataFrame) -> Column:
    """The features of ``feature_rows`` as one array."""
    return F.array(*[F.col(f"x{i}") for i in range(len(rows.columns) - 2)])


def fit_models(
    dataset: DataFrame,
    ridge: float = 1e-3,
    rounds: int = 50,
    tolerance: float = 1e-8,
) -> DataFrame:
    """Constant or logistic model for every treatment variable.

    All logistic models advance together: each round is one aggregate over the
    rows of the variables still moving, giving gradient and curvature sums, and
    one Newton step per variable. ``ridge`` weighs half the squared norm of the
    standardised coefficients against the mean log-loss; the intercept is free.
    Only finished fits are returned: variables still moving after ``rounds`` are
    an error, and so are outcomes other than 0 and 1. A variable that has one outcome on all rows
    that have a treatment gets a constant model.
    """
    names = [*covariate_columns(dataset), "TreatmentVal"]
    rows = settle(feature_rows(dataset))
    constants = settle(constant_models(dataset))
    others = rows.where(~F.col("y").isin(0.0, 1.0)).join(constants, "treatment_var", "left_anti")
    for row in others.select("treatment_var").limit(1).collect():
        raise ValueError(f"outcomes of {row.treatment_var!r} are not all 0 or 1; binarize them first")
    constants = constants.unionByName(_left_with_one_class(rows, constants, names))
    state = settle_measured(_start(rows, len(names)))
    moving, done = state.rows, [state.table.where("false").withColumn("converged", F.lit(True))]
    for _ in range(rounds):
        if not moving:
            break
        stepped = _round(rows, state, len(names), ridge, tolerance)
        state = settle_measured(stepped, moving=F.count_if(~F.col("converged")))
        moving = state.counts["moving"]
        done.append(state.table.where("converged"))
    if moving:
        some = state.table.where("NOT converged").select("treatment_var").limit(5).collect()
        raise RuntimeError(
            f"{moving} variables still move after {rounds} rounds, among them "
            f"{sorted(r.treatment_var for r in some)}; allow more rounds or a larger ridge"
        )
    fitted = union_all(done)
    logistic = fitted.select(
        "treatment_var",
        F.lit(LOGISTIC).alias("kind"),
        F.lit(None).cast("int").alias("const_class"),
        F.array(*[F.lit(c) for c in names]).alias("features"),
        F.zip_with(F.slice("beta", 2, len(names)), "scale", lambda b, s: b / s).alias("coef"),
        (
            F.element_at("beta", 1)
            - F.aggregate(
                F.zip_with(
                    F.zip_with(F.slice("beta", 2, len(names)), "scale", lambda b, s: b / s),
                    "shift",
                    lambda b, m: b * m,
                ),
                F.lit(0.0),
                lambda a, v: a + v,
            )
        ).alias("intercept"),
    )
    return settle(constants.unionByName(logistic))


def _left_with_one_class(rows: DataFrame, constants: DataFrame, names: list[str]) -> DataFrame:
    """Constant models of variables that have two outcomes, but one where they have a treatment."""
    classes = rows.groupBy("treatment_var").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    alone = classes.where("low = high").join(constants, "treatment_var", "left_anti")
    return alone.select(
        "treatment_var",
        F.lit(CONSTANT).alias("kind"),
        F.col("low").cast("int").alias("const_class"),
        F.array(*[F.lit(c) for c in names]).alias("features"),
        F.lit(None).cast("array<double>").alias("coef"),
        F.lit(None).cast("double").alias("intercept"),
    )


def fit_residuals(dataset: DataFrame, models: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """``(treatment_var, residual, mean_score)`` of each logistic model on the rows it was fitted to.

    ``residual`` is the largest part, by size, of the gradient of what ``fit_models`` minimises, for features of
    mean 0 and deviation 1: 0 where the fit is done. ``mean_score`` is the average probability of outcome 1.
    """
    rows = feature_rows(dataset)
    d = len(rows.columns) - 2
    logistic = models.where(F.col("kind") == LOGISTIC).select("treatment_var", "coef", "intercept")
    x = [F.col(f"x{i}") for i in range(d)]
    score = sum((v * F.col("coef")[i] for i, v in enumerate(x)), F.col("intercept"))
    scored = attach(rows, logistic, ["treatment_var"]).withColumn("p", 1 / (1 + F.exp(-score)))
    miss = F.col("p") - F.col("y")
    sums = scored.groupBy("treatment_var").agg(
        F.avg("p").alias("mean_score"),
        F.avg(miss).alias("miss"),
        F.first("coef").alias("coef"),
        *[F.avg(miss * v).alias(f"m{i}") for i, v in enumerate(x)],
        *[F.avg(v).alias(f"a{i}") for i, v in enumerate(x)],
        *[F.stddev_samp(v).alias(f"s{i}") for i, v in enumerate(x)],
    )
    parts = [
        F.when(
            F.col(f"s{i}") > 0,
            F.abs((F.col(f"m{i}") - F.col(f"a{i}") * F.col("miss")) / F.col(f"s{i}") + ridge * F.col("coef")[i] * F.col(f"s{i}")),
        ).otherwise(0.0)
        for i in range(d)
    ]
    return sums.select("treatment_var", F.greatest(F.abs("miss"), *parts).alias("residual"), "mean_score")


def _start(rows: DataFrame, d: int) -> DataFrame:
    """Zero coefficients, with mean and deviation of each feature, where both classes occur."""
    x = [F.col(f"x{i}") for i in range(d)]
    summary = rows.groupBy("treatment_var").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("y").alias("rate"),
        F.array(*[F.avg(v) for v in x]).alias("shift"),
        F.array(*[F.coalesce(F.stddev_samp(v), F.lit(0.0)) for v in x]).alias("spread"),
    )
    return summary.where("rate > 0 AND rate < 1").select(
        "treatment_var",
        "n",
        "shift",
        # a feature that never varies gets no coefficient
        F.transform("spread", lambda s: F.when(s > 0, s).otherwise(F.lit(float("inf")))).alias(
            "scale"
        ),
        F.concat(
            F.array(F.log(F.col("rate") / (1 - F.col("rate")))), F.array_repeat(F.lit(0.0), d)
        ).alias("beta"),
        F.lit(None).cast("array<double>").alias("last"),
        F.lit(float("inf")).alias("best"),
    )


STATE_SCHEMA = (
    "treatment_var string, n double, shift array<double>, scale array<double>, "
    "beta array<double>, last array<double>, best double"
)


def _round(
    rows: DataFrame, settled: Settled, d: int, ridge: float, tolerance: float
) -> DataFrame:
    state = settled.table
    if "converged" in state.columns:
        state = state.where("NOT converged").drop("converged")
    params = state.select("treatment_var", "shift", "scale", "beta")
    joined = attach(rows, params, ["treatment_var"], size=settled.bytes)
    width = d + 1
    sums = (
        _sums_in_jvm(joined, d)
        if width * (width + 1) // 2 <= SUMS_IN_JVM
        else _sums_in_numpy(joined, d)
    )

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                [_newton(row, width, ridge, tolerance) for row in batch.itertuples()],
                columns=[c.strip().split()[0] for c in schema.split(", ")],
            )

    schema = f"{STATE_SCHEMA}, converged boolean"
    return state.join(sums, "treatment_var").mapInPandas(step, schema)


def _newton(row, width: int, ridge: float, tolerance: float) -> tuple:
    """Next coefficients of one variable, halving the step when the loss went up."""
    beta = np.asarray(row.beta, dtype=float)
    penalty = np.full(width, ridge)
    penalty[0] = 0.0
    loss = row.loss / row.n + 0.5 * float(penalty @ beta**2)
    if loss > row.best + 1e-12 * max(1.0, abs(row.best)):
        last = np.asarray(row.last, dtype=float)
        middle = (beta + last) / 2
        stuck = bool(np.max(np.abs(middle - last)) < tolerance)
        return (*row[1:5], list(middle), list(last), row.best, stuck)
    gradient = np.asarray(row.gradient) / row.n + penalty * beta
    curvature = np.zeros((width, width))
    curvature[np.triu_indices(width)] = np.asarray(row.curvature) / row.n
    curvature = curvature + np.triu(curvature, 1).T + np.diag(penalty)
    move = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
    converged = bool(np.max(np.abs(move)) < tolerance)
    return (*row[1:5], list(beta - move), list(beta), loss, converged)


def _scaled(d: int) -> list[Column]:
    return [F.lit(1.0)] + [
        (F.col(f"x{i}") - F.col("shift")[i]) / F.col("scale")[i] for i in range(d)
    ]


def _sums_in_jvm(joined: DataFrame, d: int) -> DataFrame:
    """Loss, gradient and upper triangle of the curvature, as plain column sums."""
    z = [f"z{i}" for i in range(d + 1)]
    rows = joined.select(
        "treatment_var", "y", "beta", *[c.alias(n) for c, n in zip(_scaled(d), z)]
    )
    score = sum((F.col(n) * F.col("beta")[i] for i, n in enumerate(z)), F.lit(0.0))
    rows = rows.withColumn("score", score)
    rows = rows.withColumn("p", 1 / (1 + F.exp(-F.col("score"))))
    rows = rows.withColumn("w", F.col("p") * (1 - F.col("p")))
    loss = F.greatest("score", F.lit(0.0)) + F.log1p(F.exp(-F.abs("score")))
    return rows.groupBy("treatment_var").agg(
        F.sum(loss - F.col("y") * F.col("score")).alias("loss"),
        F.array(*[F.sum((F.col("p") - F.col("y")) * F.col(n)) for n in z]).alias("gradient"),
        F.array(
            *[
                F.sum(F.col("w") * F.col(z[i]) * F.col(z[j]))
                for i in range(d + 1)
                for j in range(i, d + 1)
            ]
        ).alias("curvature"),
    )


def _sums_in_numpy(joined: DataFrame, d: int) -> DataFrame:
    """The same sums for many features: matrix products per batch, added up by position."""
    width = d + 1
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for var, part in batch.groupby("treatment_var", sort=False):
                first = part.iloc[0]
                x = part[[f"x{i}" for i in range(d)]].to_numpy()
                z = np.ones((len(part), width))
                z[:, 1:] = (x - np.asarray(first["shift"])) / np.asarray(first["scale"])
                y = part["y"].to_numpy()
                score = z @ np.asarray(first["beta"])
                p = 1 / (1 + np.exp(-score))
                loss = np.maximum(score, 0) + np.log1p(np.exp(-np.abs(score))) - y * score
                curve = (z * (p * (1 - p))[:, None]).T @ z
                out.append((var, np.concatenate([[loss.sum()], z.T @ (p - y), curve[upper]])))
            yield pd.DataFrame(out, columns=["treatment_var", "sums"])

    partials = joined.mapInPandas(partial, "treatment_var string, sums array<double>")
    added = (
        partials.select("treatment_var", F.posexplode("sums").alias("at", "v"))
        .groupBy("treatment_var", "at")
        .agg(F.sum("v").alias("v"))
        .groupBy("treatment_var")
        .agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("sums"))
    )
    sums = F.transform("sums", lambda s: s["v"])
    return added.select(
        "treatment_var",
        sums[0].alias("loss"),
        F.slice(sums, 2, width).alias("gradient"),
        F.slice(sums, 2 + width, len(upper[0])).alias("curvature"),
    )


def fit_forest(dataset: DataFrame, variables: list[str], **params) -> dict:
    """Random forest of each named variable, a model of Spark's ML library; ``params`` are those of its ``RandomForestClassifier``.

    The trees grow by the library's rules, but from counts of rows that no split can tell apart (see ``forests``), so the
    dataset is read once per variable, not once per level. One job series per variable, so name the few that matter;
    pass a settled table.
    """
    from pyspark.ml.classification import RandomForestClassifier

    means = settle_measured(covariate_means(dataset)).table
    rows = feature_rows(dataset, means)
    forest = RandomForestClassifier(featuresCol="features", labelCol="y", **{"seed": 1, **params})

    def sampled(share: float) -> DataFrame:
        # drawn from the dataset, since what is left out need not be filled
        return feature_rows(dataset.where(F.rand(forest.getSeed()) < share), means)

    models = {}
    for variable, facts in facts_of(label_rows(dataset), variables, forest, sampled).items():
        # every level reads the cells: only this variable's, which are gone before the next one's are written
        own = settle(bagged_cells(rows.where(F.col("treatment_var") == variable), facts, forest))
        models[variable] = as_model(grow(own, facts, forest), facts, forest, dataset.sparkSession)
        drop_settled(own)
    return models


def models_missing(dataset: DataFrame, models: DataFrame) -> DataFrame:
    """Treatment variables without a model; they are left out of the ranking."""
    return treatment_vars(dataset).join(models, "treatment_var", "left_anti")
