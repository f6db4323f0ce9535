"""Forests grown from counts are those of Spark's ML library, and no pass after the first is over the rows."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracewright.operators import counterfactual as cf
from tracewright.operators import forests
from tracewright.operators import models as md
from tracewright.plans import inputs
from tracewright.session import settle

SF = "/root/testdata/sf0.001"
SCHEMA = "cov_a double, cov_b double, cov_c double, TreatmentVar string, TreatmentVal double, Outcome int"


def sample(spark, n=3000, classes=2):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        a, b, t = rng.gauss(0, 1), float(rng.randint(0, 60)), rng.choice([-1.5, 0.0, 2.0])
        level = a + 0.05 * b * (t > 0) + rng.gauss(0, 0.7)
        rows.append((None if i % 50 == 0 else a, b, None, "x" if i % 3 else "z", t, sum(level > c for c in range(1, classes))))
    return spark.createDataFrame(rows, SCHEMA)


def vectors(data, var):
    rows = md.feature_rows(data)
    return rows.where(F.col("treatment_var") == var).select(
        "y", array_to_vector(md.feature_array(rows)).alias("features")
    )


def by_the_library(rows, path, **params):
    """Its model, written and read again, which leaves out the training run."""
    RandomForestClassifier(labelCol="y", **params).fit(rows).save(str(path))
    return RandomForestClassificationModel.load(str(path))


def body(model):
    return [tree.toDebugString.split("\n", 1)[1] for tree in model.trees]


@pytest.mark.parametrize(
    "classes, params",
    [
        (2, {"maxDepth": 4}),
        (3, {"maxDepth": 3, "impurity": "entropy"}),
        (2, {"maxDepth": 5, "minInstancesPerNode": 40, "maxBins": 8}),
        (2, {"maxDepth": 5, "minInfoGain": 0.01, "minWeightFractionPerNode": 0.05}),
        (2, {"maxDepth": 0}),
        (1, {"maxDepth": 2}),
    ],
)
def test_the_same_tree_as_the_library(spark, tmp_path, classes, params):
    data = sample(spark, classes=classes)
    params = {"numTrees": 1, "bootstrap": False, "seed": 3, **params}
    ours = md.fit_forest(data, ["x"], **params)["x"]
    theirs = by_the_library(vectors(data, "x"), tmp_path / "theirs", **params)
    assert body(ours) == body(theirs)
    assert (ours.numClasses, ours.numFeatures, ours.getMaxDepth()) == (theirs.numClasses, 4, params["maxDepth"])
    assert list(ours.featureImportances) == pytest.approx(list(theirs.featureImportances), abs=1e-12)
    pairs = zip(*[m.transform(vectors(data, "x")).select("probability", "prediction").collect() for m in (ours, theirs)])
    assert all(list(a.probability) == pytest.approx(list(b.probability)) and a.prediction == b.prediction for a, b in pairs)


@pytest.mark.parametrize("together", [True, False])
def test_forests_predict_as_well_as_the_library(spark, monkeypatch, together, tmp_path):
    if not together:
        monkeypatch.setattr(forests, "MOST_POINTS", 0)
    data = sample(spark)
    params = {"numTrees": 12, "maxDepth": 4, "seed": 2}
    ours = md.fit_forest(data, ["x"], **params)["x"]
    again = md.fit_forest(data, ["x"], **params)["x"]
    theirs = by_the_library(vectors(data, "x"), tmp_path / "theirs", **params)
    assert body(ours) == body(again) and len(set(body(ours))) == 12
    rows = vectors(data, "x").cache()
    right = [m.transform(rows).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0] for m in (ours, theirs)]
    assert right[0] == pytest.approx(right[1], abs=0.03) and right[0] > 0.75
    ours.save(str(tmp_path / "forest"))
    assert body(RandomForestClassificationModel.load(str(tmp_path / "forest"))) == body(ours)


def plain_averages(data, model, var):
    """Every row predicted for every representative value."""
    rows = md.feature_rows(data).where(F.col("treatment_var") == var)
    reps = cf.representative_values(data).where(F.col("treatment_var") == var)
    grid = rows.join(reps, "treatment_var").withColumn("rep", F.explode("reps"))
    grid = grid.withColumn("features", array_to_vector(F.array("x0", "x1", "x2", "rep")))
    averages = model.transform(grid).groupBy("rep").agg(F.avg((F.col("prediction") == 1).cast("int")).alias("p"))
    return {(var, r.rep): r.p for r in averages.collect()}


@pytest.mark.parametrize("together", [True, False])
def test_scores_are_those_of_all_rows(spark, monkeypatch, together):
    data = sample(spark)
    found = md.fit_forest(data, ["x", "z"], numTrees=5, maxDepth=4)
    if not together:
        monkeypatch.setattr(forests, "MOST_POINTS", 0)
    got = {(r.treatment_var, r.rep): r.avg_outcome for r in cf.score_forest(data, found).collect()}
    assert got == pytest.approx(plain_averages(data, found["x"], "x") | plain_averages(data, found["z"], "z"))
    assert len(set(got.values())) > 2


def test_equal_rows_are_trained_on_once(spark, monkeypatch):
    written = []

    def settle(df, f=md.settle):
        table = f(df)
        written.append((table.count(), table.select(F.explode("y").alias("n")).agg(F.sum("n")).first()[0]))
        return table

    monkeypatch.setattr(md, "settle", settle)
    rows = spark.range(6000).select(
        (F.col("id") % 5).cast("double").alias("cov_a"),
        F.lit("v").alias("TreatmentVar"),
        (F.col("id") % 3).cast("double").alias("TreatmentVal"),
        (F.col("id") % 2).cast("int").alias("Outcome"),
    )
    md.fit_forest(rows, ["v"], numTrees=2, maxDepth=2, bootstrap=False)
    # 15 cells, and no row lost: each counts in both trees
    assert written == [(15, 12000)]


def test_equal_rows_are_predicted_once(spark):
    data = sample(spark)
    found = md.fit_forest(data, ["x"], numTrees=2, maxDepth=2)
    plan = cf.score_forest(data, found)._jdf.queryExecution().optimizedPlan().toString()
    predicted = [line for line in plan.splitlines() if "UDF" in line]
    below = plan[plan.index(predicted[-1]):]
    assert "count(1)" in below


def test_rows_the_library_refuses(spark):
    data = sample(spark, n=60)
    for spoilt, said in (
        (data.withColumn("Outcome", F.lit(-1)), "outcomes of 'x'"),
        (data.withColumn("Outcome", F.lit(None).cast("int")), "outcomes of 'x'"),
        (data.withColumn("Outcome", F.lit(0.5)), "outcomes of 'x'"),
        (data.withColumn("Outcome", F.lit(float("nan"))), "outcomes of 'x'"),
        (data.where("TreatmentVar = 'z'"), "no rows of 'x'"),
    ):
        with pytest.raises(ValueError, match=said):
            md.fit_forest(spoilt, ["x"], numTrees=2)
    for value in ("inf", "-inf", "nan"):
        one = F.when(F.col("cov_b") > 30, F.lit(float(value))).otherwise(F.col("TreatmentVal"))
        with pytest.raises(PySparkException, match="must not be NaN or infinite"):
            md.fit_forest(data.withColumn("TreatmentVal", one), ["x"], numTrees=2)


def test_draws_of_a_cell_are_those_of_its_rows(spark):
    rows = spark.range(40000).select(
        F.lit("v").alias("treatment_var"), (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 40 > 3).cast("double").alias("x0")
    )
    facts = forests.Facts(40000, 2, [[0.5]])
    for params, mean, spread in (({"subsamplingRate": 0.5}, 0.5, 0.5), ({"subsamplingRate": 0.5, "bootstrap": False}, 0.5, 0.25)):
        forest = RandomForestClassifier(numTrees=400, seed=1, **params)
        cells = {tuple(r.features): np.array(r.y).reshape(400, 2) for r in forests.bagged_cells(rows, facts, forest).collect()}
        assert set(cells) == {(0,), (1,)}
        for key, n in (((0,), 2000), ((1,), 18000)):
            drawn = cells[key]
            assert drawn.mean() == pytest.approx(n * mean, rel=0.01)
            assert drawn.var() == pytest.approx(n * spread, rel=0.25)


def test_treatments_of_written_lines(spark):
    asked = inputs.numeric_dataset(spark, SF)
    got = inputs.treatments_of(settle(inputs.numeric_lines(spark, SF, spread_out=True)))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in asked.schema]
    assert asked.count() == got.count() and not asked.exceptAll(got).count()
    # who asks for one variable reads the lines once
    plan = got.where("TreatmentVar = 'tax'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
