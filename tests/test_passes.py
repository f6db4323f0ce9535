"""How often queries read their records, and what they send through the driver."""

from pyspark.sql import functions as F

from tracewright.functions.bags import with_bag
from tracewright.operators import dataset as ds
from tracewright.operators import models
from tracewright.plans import queries
from tracewright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_unread_bags_are_not_parsed(spark):
    rows = spark.createDataFrame([(1, "a=1;a=2")], "row_id int, Covariates string")
    counted = with_bag(rows).agg(F.count("row_id"))
    assert "split(" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert with_bag(rows).first().bag == {"cov_a": "2"}


def test_treatments_follow_from_one_pass(spark):
    rows = [(0, "v", "2"), (1, "v", "NaN"), (2, "v", "2"), (3, "v", "8"), (4, "c", "x"), (5, "c", None), (6, None, "7")]
    records = spark.createDataFrame(rows, "row_id int, TreatmentVar string, TreatmentVal string")
    values = ds.distinct_treatments(records, ["row_id"])
    assert {(r.TreatmentVar, r.TreatmentVal, r["at"], r.n) for r in values.collect()} == {
        ("v", "2", 0, 2), ("v", "NaN", 1, 1), ("v", "8", 3, 1), ("c", "x", 4, 1), ("c", None, 5, 1), (None, "7", 6, 1),
    }
    types = {tuple(r) for r in ds.types_of_treatments(values).collect()}
    assert types == {tuple(r) for r in ds.treatment_types(records).collect()}
    got = ds.treatment_values(records, ["row_id"]).orderBy("row_id").collect()
    assert [r.value for r in got] == [2.0, 2.0, 2.0, 8.0, 0.0, -1.0, 7.0]


def test_cells_are_parsed_once(spark):
    for name in ("median_impute", "fill_covariates", "per_test_aggregate"):
        read = QUERIES[name](spark, SF).inputFiles()
        assert read and not any("orders" in f for f in read), name


def test_fits_write_only_what_they_read(spark, monkeypatch):
    assert "TestArgs" not in queries._fitted_on(spark, SF).columns
    written = []
    monkeypatch.setattr(models, "settle", lambda df, f=models.settle: written.append(df.columns) or f(df))
    rows = [(float(i), "v", float(i % 3), i % 2) for i in range(40)]
    dataset = spark.createDataFrame(rows, "cov_a double, TreatmentVar string, TreatmentVal double, Outcome int")
    assert list(models.fit_forest(dataset, ["v"], numTrees=2, maxDepth=2)) == ["v"]
    assert written == [["y", "features"]]
