import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import counterfactual as cf
from tracewright.operators import models as md
from tracewright.plans.pipeline import rank_dataset, rank_records
from tracewright.sources import models as store

SCHEMA = "TestArgs string, cov_a double, cov_b double, TreatmentVar string, TreatmentVal double, Outcome int"


def sample(spark, n=400):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        a, b, t = rng.gauss(0, 1), rng.uniform(0, 5), rng.choice([0.0, 1.0, 2.0])
        p = 1 / (1 + math.exp(-(0.7 * a - 0.4 * b + 1.1 * t)))
        rows.append((f"t{i}", a, b, "x" if i % 4 else "hot", t, int(rng.random() < p)))
    rows += [(f"c{i}", 1.0, None, "flat", float(i % 5), 1) for i in range(10)]
    return spark.createDataFrame(rows, SCHEMA)


def values_of(spark, *values):
    rows = [("t", None, None, "v", v, 1) for v in values]
    return spark.createDataFrame(rows, SCHEMA)


def test_logistic_agrees_with_spark_ml(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = sample(spark)
    ours = {r.treatment_var: r for r in md.fit_models(data, ridge=0.01).collect()}
    for var in ("x", "hot"):
        rows = VectorAssembler(
            inputCols=["cov_a", "cov_b", "TreatmentVal"], outputCol="features"
        ).transform(data.where(F.col("TreatmentVar") == var))
        ml = LogisticRegression(
            labelCol="Outcome", regParam=0.01, elasticNetParam=0.0, tol=1e-12, maxIter=500
        ).fit(rows)
        assert ours[var].features == ["cov_a", "cov_b", "TreatmentVal"]
        assert ours[var].coef == pytest.approx(list(ml.coefficients), abs=1e-5)
        assert ours[var].intercept == pytest.approx(ml.intercept, abs=1e-5)


def test_many_features_take_the_matrix_path(spark, monkeypatch):
    data = sample(spark)
    jvm = {r.treatment_var: r for r in md.fit_models(data).collect()}
    monkeypatch.setattr(md, "SUMS_IN_JVM", 0)
    numpy = {r.treatment_var: r for r in md.fit_models(data).collect()}
    for var in ("x", "hot"):
        assert numpy[var].coef == pytest.approx(jvm[var].coef, abs=1e-6)
        assert numpy[var].intercept == pytest.approx(jvm[var].intercept, abs=1e-6)


def test_one_outcome_gives_a_constant_model(spark, tmp_path):
    models = md.fit_models(sample(spark))
    path = str(tmp_path / "models")
    store.save_models(models, path)
    flat = store.load_models(spark, path).where("treatment_var = 'flat'").first()
    assert (flat.kind, flat.const_class) == ("constant", 1)


def test_unfinished_fits_are_an_error(spark):
    with pytest.raises(RuntimeError, match="still move after 1 rounds"):
        md.fit_models(sample(spark), rounds=1)


def test_separable_rows_still_give_a_model(spark):
    rows = [
        ("1", 6.5, 0.0, "v", 2.0, 1), ("2", 6.5, 0.0, "v", 6.0, 0), ("3", 6.5, 0.0, "v", 10.0, 1),
        ("4", 0.0, 0.0, "w", 1.0, 0), ("5", 0.0, 0.0, "w", 2.0, 1),
    ]
    data = spark.createDataFrame(rows, SCHEMA)
    models = md.fit_models(data)
    assert models.count() == 2
    assert all(math.isfinite(c) for r in models.collect() for c in (*r.coef, r.intercept))
    grid = cf.predict_grid(data, models)
    assert {r.predicted for r in grid.collect()} <= {0.0, 1.0}


@pytest.mark.parametrize(
    "values, expected",
    [
        ([0, 1, 0, 1, 0], [0, 1]),
        ([0, 0], [0, 1]),
        ([1], [0, 1]),
        ([1, 2, 3, 4, 5], [1, 3, 5]),
        ([1, 2, 3, 4, 4], [1, 3, 4]),
        ([10, 20], [10, 20]),
        ([5, 5, None], [5]),
        ([0, 1, 2], [0, 1, 2]),
    ],
)
def test_representative_values(spark, values, expected):
    data = values_of(spark, *[None if v is None else float(v) for v in values])
    assert [r.reps for r in cf.representative_values(data).collect()] == [expected]


def test_single_value_gives_each_row_once(spark):
    data = values_of(spark, 5.0, 5.0)
    grid = cf.counterfactual_grid(data, cf.representative_values(data)).collect()
    assert [r.rep for r in grid] == [5.0, 5.0]


def test_outcomes_other_than_0_and_1_are_classes(spark):
    data = values_of(spark, 1.0, 2.0).withColumn("Outcome", F.lit(2))
    row = md.class_cardinality(data).first()
    assert (row.n_classes, row.min_class) == (1, 2)
    assert md.constant_models(data).first().const_class == 2


def test_ranking_without_covariates(spark):
    rows = [("t", "", "v", str(i), str(int(i > 3))) for i in range(8)]
    schema = "TestArgs string, Covariates string, TreatmentVar string, TreatmentVal string, Outcome string"
    records = spark.createDataFrame(rows, schema).withColumn("row_id", F.col("TreatmentVal").cast("bigint"))
    ranked = rank_records(records, ["row_id"]).collect()
    assert [r.treatment_var for r in ranked] == ["v"] and ranked[0].score > 0


def test_ranking_with_dots_in_names(spark):
    rows = [(i, "t", f"a.b={i % 3};c.d={'xy'[i % 2]}", "v.w", str(i), str(int(i > 3))) for i in range(8)]
    schema = "row_id bigint, TestArgs string, Covariates string, TreatmentVar string, TreatmentVal string, Outcome string"
    ranked = rank_records(spark.createDataFrame(rows, schema), ["row_id"]).collect()
    assert [r.treatment_var for r in ranked] == ["v.w"] and ranked[0].score > 0


def linear(spark, kind, const, coef, intercept):
    features = ["cov_a", "cov_b", "TreatmentVal"]
    return spark.createDataFrame([("v", kind, const, features, coef, intercept)], md.MODEL_SCHEMA)


def test_known_score(spark):
    rows = [("1", -3.0, 0.0, "v", 0.0, 1), ("2", 0.0, 0.0, "v", 1.0, 0), ("3", 3.0, None, "v", 2.0, 0)]
    data = spark.createDataFrame(rows, SCHEMA)
    models = linear(spark, "logistic", None, [1.0, 0.0, 2.0], -1.5)
    averages = {r.rep: r.avg_outcome for r in cf.avg_outcome_by_rep(data, models).collect()}
    assert averages == {0.0: 1 / 3, 1.0: 2 / 3, 2.0: 2 / 3}
    score = rank_dataset(data, models).first().score
    assert score == pytest.approx(1 / 3)
    by_grid = cf.predict_grid(data, models).groupBy("rep").agg(F.avg("predicted").alias("p"))
    assert {r.rep: r.p for r in by_grid.collect()} == averages


def test_constant_unknown_and_failing_models(spark):
    data = values_of(spark, 1.0, 2.0, 3.0)
    constant = cf.avg_outcome_by_rep(data, linear(spark, "constant", 1, None, None)).collect()
    assert {r.avg_outcome for r in constant} == {1.0}
    unknown = cf.avg_outcome_by_rep(data, linear(spark, "mystery", 1, None, None)).collect()
    assert {r.avg_outcome for r in unknown} == {0.0}
    broken = cf.avg_outcome_by_rep(data, linear(spark, "logistic", None, None, None)).collect()
    assert {r.avg_outcome for r in broken} == {0.5}


def test_custom_model(spark):
    @F.pandas_udf("int")
    def above_two(features: pd.Series) -> pd.Series:
        return features.map(lambda x: int(x[-1] > 2))

    data = values_of(spark, 1.0, 2.0, 3.0)
    models = linear(spark, "custom", None, None, None)
    got = cf.avg_outcome_by_rep(data, models, custom=above_two).collect()
    assert {r.rep: r.avg_outcome for r in got} == {1.0: 0.0, 2.0: 0.0, 3.0: 1.0}


def test_variable_without_model_is_left_out(spark):
    data = sample(spark)
    models = md.fit_models(data).where("treatment_var <> 'hot'")
    assert [r.treatment_var for r in md.models_missing(data, models).collect()] == ["hot"]
    assert {r.treatment_var for r in rank_dataset(data, models).collect()} == {"x", "flat"}


def test_coerce_skips_a_header_row(spark):
    raw = spark.createDataFrame(
        [("TestArgs", "cov_a", "TreatmentVar", "TreatmentVal", "Outcome"), ("t", "true", "v", "2", "0")],
        "TestArgs string, cov_a string, TreatmentVar string, TreatmentVal string, Outcome string",
    )
    assert [tuple(r) for r in cf.coerce_rows(raw).collect()] == [("t", 1.0, "v", 2.0, 0.0)]


def test_forest(spark):
    data = sample(spark)
    forests = md.fit_forest(data, ["x"], numTrees=5, maxDepth=3)
    scores = cf.suspiciousness(cf.score_forest(data, forests)).collect()
    assert [r.treatment_var for r in scores] == ["x"]
    assert 0 < scores[0].score <= 1


def test_the_guilty_variable_ranks_first(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        bad, noise = rng.randint(0, 9), rng.randint(0, 9)
        outcome = str(int(bad > 4))
        rows.append((2 * i, "t", f"noise={noise}", "bad", str(bad), outcome))
        rows.append((2 * i + 1, "t", "other=1", "noise", str(noise), outcome))
    records = spark.createDataFrame(
        rows, "row_id bigint, TestArgs string, Covariates string, TreatmentVar string, "
        "TreatmentVal string, Outcome string"
    )
    ranked = rank_records(records, ["row_id"])
    first, second = ranked.collect()
    assert (first.treatment_var, first.score) == ("bad", 1.0)
    assert cf.ranking(ranked, exclude_vars=["bad"]).collect() == [second]


def test_other_outcomes_are_not_fitted(spark):
    data = sample(spark).withColumn("Outcome", F.when(F.col("TreatmentVar") == "hot", F.col("Outcome") * 3).otherwise(F.col("Outcome")))
    with pytest.raises(ValueError, match="'hot'"):
        md.fit_models(data)


def test_one_outcome_where_there_is_a_treatment(spark):
    rows = [("t", 1.0, 1.0, "half", float(i), 1) for i in range(4)] + [("t", 1.0, 1.0, "half", None, 0)]
    model = md.fit_models(spark.createDataFrame(rows, SCHEMA)).first()
    assert (model.treatment_var, model.kind, model.const_class) == ("half", "constant", 1)


def test_residuals_tell_a_finished_fit(spark):
    data = sample(spark)
    models = md.fit_models(data)
    moved = models.withColumn("intercept", F.col("intercept") + 0.1)
    good, bad = ({r.treatment_var: r for r in md.fit_residuals(data, m).collect()} for m in (models, moved))
    share = {r.TreatmentVar: r.y for r in data.groupBy("TreatmentVar").agg(F.avg("Outcome").alias("y")).collect()}
    assert set(good) == {"x", "hot"}
    for var in good:
        assert good[var].residual < 1e-6 < 1e-3 < bad[var].residual
        assert good[var].mean_score == pytest.approx(share[var], abs=1e-6)
