from pyspark.sql import functions as F

from tracewright.operators import assignments as asg
from tracewright.sources import traces
from tracewright.streaming.live import (
    append_finished_runs,
    read_live_trace,
    running_last_values,
)

TRACE = "run_id bigint, seq bigint, line string"
PARENTS = "var string, pos int, parent string"


def trace_of(spark, *runs):
    rows = [(r, i, line) for r, lines in enumerate(runs) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, TRACE)


def records_of(spark, runs, parents=()):
    rec = asg.execution_records(
        trace_of(spark, *runs), spark.createDataFrame(list(parents), PARENTS)
    )
    return [
        (r.run_id, r.Covariates, r.TreatmentVar, r.TreatmentVal, r.Outcome)
        for r in rec.orderBy("run_id", "first_seq").collect()
    ]


def test_line_format(spark):
    values = spark.createDataFrame(
        [(0, 0, "a", "100"), (0, 1, "b", "test string"), (0, 2, "c", None)],
        "run_id bigint, seq bigint, var string, value string",
    )
    lines = [r.line for r in traces.log_lines(values).orderBy("seq").collect()]
    assert lines == ["a = 100", "b = test string", "c = null"]


def test_parse_splits_at_first_equals_and_skips_separators(spark):
    lines = ["b = x=y", "  ----- = -----", "no assignment", "\tc\t=\t1 ", "d = "]
    got = asg.parse_assignments(trace_of(spark, lines)).orderBy("seq").collect()
    assert [(r["var"], r["value"]) for r in got] == [("b", "x=y"), ("c", "1"), ("d", "")]


def test_temporaries_get_no_record(spark):
    got = records_of(
        spark, [["temp_1 = 8", "speed = 12", "my_temp = 4", "door_debug = shut", "seats = 2"]]
    )
    assert [r[2] for r in got] == ["speed", "my_temp", "seats"]


def test_reassignment_keeps_first_seen_order(spark):
    got = records_of(spark, [["k = x", "j = 1", "k = y", "j = 2", "k = z", "h = 0"]])
    assert [(r[2], r[3]) for r in got] == [("k", "z"), ("j", "2"), ("h", "0")]


def test_null_and_empty_values(spark):
    got = records_of(spark, [["first = ", "second = null", "third =  "]])
    assert [(r[2], r[3]) for r in got] == [("first", ""), ("second", "null"), ("third", "")]


def test_empty_trace(spark):
    assert records_of(spark, []) == []


def test_covariates_follow_parent_order_and_see_temporaries(spark):
    parents = [("y", 0, "x"), ("y", 1, "gone"), ("y", 2, "temp_z"), ("x", 0, "y")]
    runs = [["x = 1", "temp_z = 5", "y = 2", "x = 3", "Outcome = 1"], ["y = 7"]]
    assert records_of(spark, runs, parents) == [
        (0, "y=2", "x", "3", "1"),
        (0, "x=3;gone=N/A;temp_z=5", "y", "2", "1"),
        (0, "", "Outcome", "1", "1"),
        (1, "x=N/A;gone=N/A;temp_z=N/A", "y", "7", "0"),
    ]


def test_outcomes(spark):
    runs = [
        ["pages = 31", "Outcome = 1"],
        ["stop = no paper", "Outcome = 0"],
        ["pages = 31"],
        ["Outcome", "OutcomeX = 7", "Outcome = 1"],
        ["Outcome = no", "Outcome = 1"],
    ]
    got = asg.run_outcomes(trace_of(spark, *runs)).orderBy("run_id").collect()
    assert [r.outcome for r in got] == [1, 0, 0, 7, 0]


def test_append_outcomes(spark):
    status = spark.createDataFrame(
        [(0, 9, None), (1, 9, "boom")], "run_id bigint, seq bigint, error string"
    )
    full = asg.append_outcomes(trace_of(spark, ["a = 1"], ["a = 2"]), status)
    assert [r.outcome for r in asg.run_outcomes(full).orderBy("run_id").collect()] == [1, 0]


def test_assignment_versions(spark):
    parsed = asg.parse_assignments(trace_of(spark, ["x = 1", "y = 1", "x = 2"]))
    got = asg.assignment_versions(parsed).orderBy("seq").collect()
    assert [r.versioned for r in got] == ["x_1", "y_1", "x_2"]


def test_success_rate_is_cut_not_rounded(spark):
    outcomes = spark.createDataFrame([(1,), (1,), (0,)], "outcome int")
    row = asg.success_rate(outcomes).first()
    assert (row.total, row.ok, row.failed, row.rate) == (3, 2, 1, 66.66)


def test_log_with_runs_over_several_files(spark, tmp_path):
    lines = [[f"v = {i}" for i in range(7)], ["w = 1"], [f"u = {i}" for i in range(5)]]
    path = str(tmp_path / "log")
    traces.write_trace(trace_of(spark, *lines), path, rows_per_file=4)
    assert len(list((tmp_path / "log").glob("part-*"))) > 2
    got = traces.read_trace(spark, path).orderBy("seq").collect()
    assert [(r.run_id, r.line) for r in got] == [
        (i, line) for i, run in enumerate(lines) for line in run
    ]


def test_log_split_inside_a_file(spark, tmp_path):
    text = "".join(
        "".join(f"x{i} = {i}\n" for i in range(50)) + "----- = -----\n" for _ in range(20)
    )
    (tmp_path / "a.log").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        read = traces.read_trace(spark, str(tmp_path / "a.log"))
        got = read.groupBy("run_id").agg(
            F.count("*").alias("n"), F.min_by("line", "seq").alias("first")
        )
        rows = sorted(got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.run_id, r.n, r["first"]) for r in rows] == [(i, 50, "x0 = 0") for i in range(20)]


def test_running_last_values(spark, tmp_path):
    src = str(tmp_path / "live")
    trace_of(spark, ["x = 1", "x = 2", "y = 3"]).write.json(src)
    query = (
        running_last_values(read_live_trace(spark, src))
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("live_values")
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = spark.table("live_values").orderBy("var").collect()
    assert [(r["var"], r["value"]) for r in got] == [("x", "2"), ("y", "3")]


def test_finished_runs_are_recorded_once(spark, tmp_path):
    logs, out, check = (str(tmp_path / n) for n in ("logs", "out", "check"))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "1.log").write_text("a = 1\nOutcome = 1\n----- = -----\na = 2\n")
    parents = spark.createDataFrame([("a", 0, "b")], PARENTS)
    append_finished_runs(spark, logs, parents, out, check).awaitTermination()
    (tmp_path / "logs" / "2.log").write_text("c = 3\n")
    append_finished_runs(spark, logs, parents, out, check).awaitTermination()
    append_finished_runs(spark, logs, parents, out, check).awaitTermination()
    got = spark.read.parquet(out).orderBy("batch_id", "run_id", "first_seq").collect()
    assert [(r.batch_id, r.TreatmentVar, r.TreatmentVal, r.Outcome) for r in got] == [
        (0, "a", "1", "1"),
        (0, "Outcome", "1", "1"),
        (0, "a", "2", "0"),
        (1, "c", "3", "0"),
    ]
    assert len({r.run_id for r in got}) == 3 and {r.batch_id for r in got if r.run_id >= 1 << 40} == {1}
