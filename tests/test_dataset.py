import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.operators import dataset as ds

RECORD = (
    "row_id bigint, TestArgs string, Covariates string, TreatmentVar string, "
    "TreatmentVal string, Outcome string"
)

SAMPLE = [
    ("rain", "depth=3.5;gate=7", "Outcome", "0", "0"),
    ("rain", "depth=3.5;gate=7;colour=red", "level", "19", "0"),
    ("sun", "gate=9;colour=blue", "pump", "idle", "1"),
    ("sun", "gate=9", "pump", "busy", "1"),
    ("wind", "depth=5.5", "Outcome", "1", "1"),
]


def records_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RECORD)


def bags_of(spark, *bags):
    return records_of(spark, [("t", b, "v", "1", "1") for b in bags])


def test_sample_dataset(spark):
    got = ds.training_dataset(records_of(spark, SAMPLE), ["row_id"]).orderBy("row_id")
    assert got.columns == [
        "row_id", "TestArgs", "cov_colour", "cov_depth", "cov_gate",
        "TreatmentVar", "TreatmentVal", "Outcome",
    ]
    rows = got.collect()
    # medians fill in numbers, -1 stands for a missing category
    assert [r.cov_depth for r in rows] == [3.5, 3.5, 3.5, 3.5, 5.5]
    assert [r.cov_gate for r in rows] == [7.0, 7.0, 9.0, 9.0, 8.0]
    assert [r.cov_colour for r in rows] == [-1, 0, 1, -1, -1]
    assert [r.TreatmentVal for r in rows] == [0.0, 19.0, 0.0, 1.0, 1.0]
    assert [r.Outcome for r in rows] == [0, 0, 1, 1, 1]


def test_covariate_columns_and_types(spark):
    records = bags_of(spark, "weight=-0.25", "colour=red;depth=1e3;weight=heavy", "open=true;depth=;colour=3")
    wide = ds.expand_covariates(records, ["row_id"])
    kinds = {k: t for k, t in wide.dtypes if k in ds.covariate_columns(wide)}
    # the first value of a key decides: "heavy" is a missing number, and "3" a word
    assert (kinds["cov_weight"], kinds["cov_depth"], kinds["cov_colour"]) == ("double", "double", "string")
    rows = wide.orderBy("row_id").collect()
    assert [r.cov_weight for r in rows] == [-0.25, None, None]
    assert [r.cov_depth for r in rows] == [None, 1000.0, None]
    assert [r.cov_colour for r in rows] == [None, "red", "3"]


def test_bag_corner_cases(spark):
    records = bags_of(spark, "a=;b=c=;d==e;=f; g = h ;plain;;x=1;x=2", None, "", " ; ")
    got = ds.parse_covariates(records, ["row_id"]).orderBy("key").collect()
    assert [(r.row_id, r.key, r.value) for r in got] == [
        (0, "cov_", "f"), (0, "cov_b", "c"), (0, "cov_g", "h"), (0, "cov_x", "2"),
    ]


def test_type_comes_from_the_first_value_even_when_overwritten(spark):
    records = bags_of(spark, "k=abc;k=5", "k=7;n=N/A", "n=3;m=1;m=zz", "m=4")
    got = ds.covariate_types(records, ["row_id"]).collect()
    expected = {"cov_k": False, "cov_n": False, "cov_m": True}
    assert {r.key: r.is_numeric for r in got} == expected
    from_values = ds.types_of(ds.covariate_values(records, ["row_id"])).collect()
    assert {r.key: r.is_numeric for r in from_values} == expected
    rows = ds.training_dataset(records, ["row_id"]).orderBy("row_id").collect()
    assert [r.cov_k for r in rows] == [0, 1, -1, -1]
    # the kept "zz" is no number: median of the others
    assert [r.cov_m for r in rows] == [4.0, 4.0, 4.0, 4.0]


def test_codes_follow_first_appearance(spark):
    records = bags_of(spark, "c=low", "c=medium", "c=high", "c=medium", "c=low")
    rows = ds.training_dataset(records, ["row_id"]).orderBy("row_id").collect()
    assert [r.cov_c for r in rows] == [0, 1, 2, 1, 0]


def test_order_of_several_columns(spark):
    records = bags_of(spark, "c=b", "c=a").withColumns(
        {"hi": 1 - F.col("row_id"), "lo": F.lit(0)}
    )
    got = ds.training_dataset(records, ["hi", "lo"]).orderBy("hi").collect()
    assert [r.cov_c for r in got] == [0, 1]


def test_treatment_types(spark):
    rows = [
        ("t", "", "n", " 1 ", "1"), ("t", "", "n", "NaN", "1"), ("t", "", "n", "4e1", "1"),
        ("t", "", "n", "3", "1"), ("t", "", "c", "1", "1"), ("t", "", "c", "x", "1"),
        ("t", "", "c", None, "1"), ("t", "", "gone", "NaN", None),
    ]
    got = ds.training_dataset(records_of(spark, rows), ["row_id"]).orderBy("row_id").collect()
    assert [r.TreatmentVal for r in got] == [1.0, 3.0, 40.0, 3.0, 0.0, 1.0, -1.0, None]
    assert got[-1].Outcome == 0


@pytest.mark.parametrize(
    "values, expected",
    [
        ([1.0, None, 3.0, 4.0, None], [1, 3, 3, 4, 3]),
        ([1.0, float("nan"), 3.0, 4.0, 4.0, 9.0], [1, 4, 3, 4, 4, 9]),
        ([1.0, 2.0, None, 4.0, 3.0], [1, 2, 2.5, 4, 3]),
        ([1.0, 2.0, 3.0], [1, 2, 3]),
        ([None, None], [None, None]),
    ],
)
def test_median_impute(spark, values, expected):
    df = spark.createDataFrame(
        [(i, "g", v) for i, v in enumerate(values)], "i int, g string, v double"
    )
    got = ds.median_impute(df, ["g"], "v").orderBy("i").collect()
    assert [r.v for r in got] == expected


def test_per_test_aggregate(spark):
    rows = [
        ("t1", "a=1;b=2", "x", "10", "1"),
        ("t1", "a=1;c=3", "x", "20", "1"),
        ("t1", "b=2;d=4", "y", "5", "1"),
        ("t1", "", "Outcome", "1", "1"),
        ("t1", "", "Outcome", "0", "1"),
        ("t2", "", "z", "word", "0"),
    ]
    got = ds.per_test_aggregate(records_of(spark, rows), ["row_id"]).collect()
    assert sorted(tuple(r) for r in got) == [
        ("t1", "a=1;c=3", "y", 5.0, 1),
        ("t1", "d=4", "x", 15.0, 1),
        ("t2", "", "z", None, 0),
    ]


def test_required_columns(spark):
    df = spark.createDataFrame([(1, 2)], "V1 int, V6 int")
    ds.require_columns(df, ["V1", "V6"])
    with pytest.raises(ValueError, match="V7"):
        ds.require_columns(df, ["V1", "V7"])


def scalar(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_parse_numeric(spark):
    given = ["true", "FALSE", "1", "0", "3.14", "not-a-number", None, "NaN", " 2\t", "1d", "1_0", "inf", ".5"]
    expected = [1, 0, 1, 0, 3.14, None, None, None, 2, None, None, None, 0.5]
    assert scalar(spark, tx.parse_numeric, given) == expected


def test_numbers(spark):
    assert scalar(spark, tx.is_number, ["NaN", "-Infinity", "1.", "1e5", "e5", "", "+.5"]) == [
        True, True, True, True, False, False, True,
    ]


def test_other_scalars(spark):
    assert scalar(spark, tx.binarize_outcome, [" Pass", "TRUE", "1", "0", None, "2"]) == [1, 1, 1, 0, 0, 0]
    assert scalar(spark, tx.csv_escape, ["a", 'a"b', "a,b", "a\nb", None]) == [
        "a", '"a""b"', '"a,b"', '"a\nb"', "",
    ]
    assert scalar(spark, tx.args_string, [["7", "15"], ["2"], []], "array<string>") == ["[7, 15]", "[2]", "[]"]
    assert scalar(spark, tx.format_score, [0.000005, 0.125, 1.0], "double") == ["0.00001", "0.12500", "1.00000"]
    assert scalar(spark, tx.normalise_label, [" a\nb ", None]) == ["a b", ""]
    assert scalar(spark, tx.escape_dot, ['f("x")']) == [r"f\(\"x\"\)"]
    assert scalar(spark, tx.base_name, ["x_1", "x_1_2", "x"]) == ["x", "x_1", "x"]


def test_large_code_tables_stay_off_the_driver(spark, monkeypatch):
    # texts whose codes come to 10 MB, beside a column of three
    n = 120_000
    at = F.col("id")
    bag = F.concat(F.lit("text=t"), (at * 7919 % n).cast("string"), F.lit(";word=w"), (at % 3).cast("string"))
    records = spark.range(n).select(
        at.alias("row_id"),
        F.lit("a").alias("TestArgs"),
        F.when(at % 5 != 0, bag).alias("Covariates"),
        F.lit("v").alias("TreatmentVar"),
        F.when(at % 4 != 0, F.concat(F.lit("s"), at.cast("string"))).alias("TreatmentVal"),
        F.lit("1").alias("Outcome"),
    )
    got = ds.training_dataset(records, ["row_id"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # broadcast: the variable's type, and the codes of the three words
    assert plan.count("strategy=broadcast") == 2
    first = {}
    for r in got.orderBy("row_id").collect():
        i = r.row_id
        word = {1: 0, 2: 1, 0: 2}[i % 3] if i % 5 else -1
        text = first.setdefault(i, len(first)) if i % 5 else -1
        value = i - i // 4 - 1 if i % 4 else -1
        assert (r.cov_text, r.cov_word, r.TreatmentVal) == (text, word, value)
