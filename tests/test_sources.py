from pyspark.sql import functions as F

from tracewright.operators.counterfactual import suspiciousness
from tracewright.operators.parent_map import parent_rows
from tracewright.sources import dot, inputs, parents, records

RECORD = "TestArgs string, Covariates string, TreatmentVar string, TreatmentVal string, Outcome string"


def test_records_round_trip(spark, tmp_path):
    rows = [
        ("[7, 15]", "a=1;b=2", "x", 'say "hi"', "1"),
        ("[2]", "", "y", "two\nlines", "0"),
        ("[3]", "c=N/A", "z", " padded ", "0"),
    ]
    path = str(tmp_path / "records")
    df = spark.createDataFrame(rows, RECORD).coalesce(1)
    records.write_records(df, path, mode="overwrite")
    got = records.read_records(spark, path).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [
        (1, *rows[0]), (2, *rows[1]), (3, "[3]", "c=N/A", "z", "padded", "0"),
    ]
    records.write_records(df, path)
    assert records.read_records(spark, path).count() == 6
    records.write_records(df, path, mode="overwrite")
    assert records.read_records(spark, path).count() == 3


def test_records_text_form(spark, tmp_path):
    path = tmp_path / "records"
    rows = [("[7, 15]", "", "x", None, "1")]
    records.write_records(spark.createDataFrame(rows, RECORD).coalesce(1), str(path))
    text = next(path.glob("part-*")).read_text()
    assert text == 'TestArgs,Covariates,TreatmentVar,TreatmentVal,Outcome\n"[7, 15]",,x,,1\n'


def test_records_with_blank_lines_and_more_columns(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "TestArgs,Covariates,TreatmentVar,TreatmentVal,Outcome,More\n"
        '"t1" , "m=1" ,x,1,1,zz\n\nt2,m=2,y,2,0,zz\n'
    )
    got = records.read_records(spark, str(tmp_path / "r.csv")).orderBy("row_id").collect()
    assert [(r.TestArgs, r.Covariates, r.TreatmentVar) for r in got] == [
        ("t1", "m=1", "x"), ("t2", "m=2", "y"),
    ]


def test_ranking_file(spark, tmp_path):
    averages = spark.createDataFrame(
        [("a", 0.0), ("a", 0.5), ("b", 0.25), ("c", 0.0), ("c", 0.5)],
        "treatment_var string, avg_outcome double",
    )
    path = tmp_path / "ranking"
    records.write_ranking(suspiciousness(averages), str(path))
    text = "".join(p.read_text() for p in sorted(path.glob("part-*")))
    assert text == "TreatmentVar,Suspiciousness Score\na,0.50000\nc,0.50000\nb,0.00000\n"


def test_parents_round_trip(spark, tmp_path):
    mapping = spark.createDataFrame(
        [("x", ["a", "b"]), ("y", []), ("z", ["x"])], "var string, refs array<string>"
    )
    path = str(tmp_path / "map")
    parents.write_parents(mapping, path)
    got = parents.read_parents(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, parent_rows(mapping).collect()))


def test_pretty_and_missing_parent_map(spark, tmp_path):
    (tmp_path / "map.json").write_text('{\n  "x": [\n    "a",\n    "b"\n  ],\n  "y": []\n}')
    got = parents.read_parents(spark, str(tmp_path / "map.json"), multi_line=True)
    assert sorted(map(tuple, got.collect())) == [("x", 0, "a"), ("x", 1, "b")]
    assert parents.read_parents(spark, str(tmp_path / "none.json")).count() == 0


def test_dot_files(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("g1", "a", "A", 0), ("g2", "b", "B", 0)], "graph_id string, node string, label string, ord int"
    )
    edges = spark.createDataFrame([("g1", "a", "a")], "graph_id string, src string, dst string")
    path = tmp_path / "dot"
    dot.write_dot(nodes, edges, str(path))
    text = "".join(p.read_text() for p in sorted((path / "graph_id=g1").glob("part-*")))
    assert text == 'digraph CFG {\n  "a" [label="A"];\n  "a" -> "a";\n}\n'


def test_random_inputs(spark):
    drawn = inputs.random_inputs(spark.range(200), "id").collect()
    words = [r.args[0] for r in drawn]
    assert all(len(r.args) == 1 for r in drawn)
    assert {len(w) for w in words} == {3, 4, 5, 6, 7}
    assert all(w.isascii() and w.isalpha() for w in words)
    again = inputs.random_inputs(spark.range(200).repartition(3), "id").orderBy("id")
    assert [r.args[0] for r in again.collect()] == words
    other = inputs.random_inputs(spark.range(200), "id", seed=1).orderBy("id")
    assert other.select(F.col("args")[0]).first()[0] != words[0]
