"""The dataset in long form against the wide one, and names and variables that the wide one cannot hold."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import dataset as ds
from tracewright.operators import long_dataset as lds
from tracewright.operators import models as md

RECORDS = "row_id bigint, TestArgs string, Covariates string, TreatmentVar string, TreatmentVal string, Outcome string"


def random_records(spark, n=200):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        keys = rng.sample(["a", "b", "c", "d", "e.f"], rng.randint(0, 5))
        bag = ";".join(f"{k}={rng.choice(['1', '2.5', 'N/A', 'x', 'true', ''])}" for k in keys)
        var = rng.choice(["p", "q", "r"])
        value = rng.choice(["1", "2", None]) if var == "p" else rng.choice(["on", "off", None, "3"])
        rows.append((i, f"t{i % 7}", bag, var, value, rng.choice(["1", "0", "pass", None])))
    return spark.createDataFrame(rows, RECORDS)


def test_long_form_holds_the_wide_dataset(spark):
    records = random_records(spark)
    wide = ds.training_dataset(records, ["row_id"])
    long = lds.long_dataset(records, ["row_id"])
    names = {r["no"]: (r["key"], r["fill"]) for r in long.names.collect()}
    assert [names[i][0] for i in range(len(names))] == sorted(k for k, _ in names.values()) == ds.covariate_columns(wide)
    got = {}
    for r in lds.gathered(long, ["row_id"]).collect():
        cells = {names[c["no"]][0]: c["value"] for c in r["cells"]}
        got[r["row_id"]] = {k: cells.get(k, fill) for k, fill in names.values()} | {"v": r["TreatmentVal"], "o": r["Outcome"]}
    for r in wide.collect():
        expected = {k: None if r[k] is None else float(r[k]) for k, _ in names.values()}
        assert got[r["row_id"]] == expected | {"v": r["TreatmentVal"], "o": r["Outcome"]}
    for key in ("cov_a", "cov_e.f"):
        one = {r["row_id"]: r["x"] for r in lds.with_cell(long, ["row_id"], key, "x").collect()}
        assert one == {i: cells[key] for i, cells in got.items()}


def test_names_that_differ_in_case_and_records_without_variable(spark):
    rows = [
        (1, "t", "n=1;N=x", None, "2", "1"),
        (2, "t", "n=3;N=y", None, None, "0"),
        (3, "t", "N=x", None, "4", "0"),
        (4, "t", "n=2", "v", "b", "1"),
        (5, "t", None, "V", "7", "1"),
    ]
    long = lds.long_dataset(spark.createDataFrame(rows, RECORDS), ["row_id"])
    keys = {r["no"]: r["key"] for r in long.names.collect()}
    assert sorted(keys.values()) == ["cov_N", "cov_n"]
    cells = {(r["row_id"], keys[r["no"]]): r["value"] for r in long.cells.collect()}
    assert cells == {(1, "cov_n"): 1, (1, "cov_N"): 0, (2, "cov_n"): 3, (2, "cov_N"): 1, (3, "cov_N"): 0, (4, "cov_n"): 2}
    assert {r["row_id"]: r["TreatmentVal"] for r in long.rows.collect()} == {1: 2, 2: 3, 3: 4, 4: 0, 5: 7}


def test_many_names_and_none(spark):
    rows = [(i, "t", f"k{i}={i}", "v", "1", "1") for i in range(7000)]
    long = lds.long_dataset(spark.createDataFrame(rows, RECORDS), ["row_id"])
    assert long.names.count() == 7000 and long.cells.where("value <> row_id").count() == 0
    empty = lds.long_dataset(spark.createDataFrame([], RECORDS), ["row_id"])
    assert [t.count() for t in empty] == [0, 0, 0]


def test_covariates_of_records_without_variable_are_filled(spark):
    rows = [(None, 1.0, 1.0, 0), (None, None, 2.0, 1), ("v", 5.0, 1.0, 0), ("v", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "TreatmentVar string, cov_a double, TreatmentVal double, Outcome int")
    filled = md.fill_covariates(df)
    assert filled.columns == df.columns
    assert sorted(map(str, map(tuple, filled.select("TreatmentVar", "cov_a").collect()))) == [
        "('v', 5.0)",
        "('v', 5.0)",
        "(None, 1.0)",
        "(None, 1.0)",
    ]


@pytest.mark.parametrize("value, expected", [("1", 1.0), ("x", 0.0)])
def test_a_null_variable_is_a_variable(spark, value, expected):
    rows = [(1, "t", "", None, value, "1"), (2, "t", "", "v", "9", "1")]
    df = ds.treatment_values(spark.createDataFrame(rows, RECORDS), ["row_id"])
    assert {r["row_id"]: r["value"] for r in df.collect()} == {1: expected, 2: 9.0}
    assert df.where(F.col("TreatmentVar").isNull()).count() == 1
