"""Runs that arrive in pieces, and tables merged by batches that may be repeated."""

import os
import random
import time

import pytest

from tracewright.functions import fixed
from tracewright.operators.assignments import execution_records
from tracewright.sources.parents import PARENTS_SCHEMA
from tracewright.sources.upserts import UpsertTable
from tracewright.streaming import live, runs


def records_of(df):
    return sorted(tuple(r) for r in df.drop("batch_id").collect())


def write_log(folder, delivery, source, name, lines):
    path = folder / str(delivery) / f"source={source}"
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("".join(f"{line}\n" for line in lines))


@pytest.fixture
def parents(spark):
    return spark.createDataFrame([("y", 0, "x"), ("y", 1, "temp_z"), ("x", 0, "y")], PARENTS_SCHEMA)


def test_runs_cut_anywhere_give_the_records_of_whole_runs(spark, tmp_path, parents):
    rng = random.Random(4)
    trace, streams = [], {}
    for source in ("a", "b b", "c"):
        log = streams[source] = []
        for run_no in range(rng.randint(3, 6)):
            names = rng.choices(["x", "y", "temp_z", "w_debug", "no sign", "long"], k=rng.randint(0, 9))
            lines = [f"{n} = {rng.randint(0, 99)}" if n != "no sign" else n for n in names]
            lines += rng.choice([[], ["Outcome = 1"], [" Outcome = 0", "Outcome = 1", "Outcome = 0"], ["----- = x"]])
            name = source.replace(" ", "%20")
            trace += [(f"{name}-{run_no}", i + 1, line) for i, line in enumerate(lines)]
            log += [*lines, fixed.SEPARATOR_LINE]
    logs, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "ck")
    for delivery in range(4):
        for source, lines in streams.items():
            cuts = sorted(rng.choices(range(len(lines) + 1), k=3)) if delivery < 3 else [len(lines)] * 3
            for k in range(2):
                write_log(logs, delivery, source, f"{k}.log", lines[: cuts[0]] if k == 0 else lines[cuts[0] : cuts[1]])
            streams[source] = lines[max(cuts[0], cuts[1]) :]
        stream = runs.read_log_files(spark, str(logs))
        runs.append_live_runs(stream, parents, out, checkpoint).awaitTermination()
    got = spark.read.parquet(f"{out}/finished")
    whole = spark.createDataFrame(trace, "run_id string, seq bigint, line string")
    assert records_of(got) == records_of(execution_records(whole, parents))
    assert not os.path.exists(f"{out}/unfinished")


def test_a_repeated_batch_replaces_its_records(spark, tmp_path, parents):
    logs, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), tmp_path / "ck"
    for delivery, lines in enumerate([["x = 1"], ["y = 2", fixed.SEPARATOR_LINE, "x = 5"]]):
        write_log(logs, delivery, "a", "0.log", lines)
        stream = runs.read_log_files(spark, str(logs))
        runs.append_live_runs(stream, parents, out, str(checkpoint)).awaitTermination()
    before = records_of(spark.read.parquet(f"{out}/finished"))
    assert [(r[0], r[4], r[5]) for r in before] == [("a-0", "x", "1"), ("a-0", "y", "2")]
    last = max((f for f in os.listdir(checkpoint / "commits") if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):  # as if the driver had died before the batch was noted
        if (checkpoint / "commits" / name).exists():
            (checkpoint / "commits" / name).unlink()
    stream = runs.read_log_files(spark, str(logs))
    runs.append_live_runs(stream, parents, out, str(checkpoint)).awaitTermination()
    assert records_of(spark.read.parquet(f"{out}/finished")) == before


def test_a_silent_source_gives_up_its_run(spark, tmp_path, parents):
    logs, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "ck")
    deliveries = [("a", ["x = 1"]), ("b", ["x = 2", fixed.SEPARATOR_LINE]), ("a", ["x = 3", fixed.SEPARATOR_LINE])]

    def named(kind):
        if not os.path.exists(f"{out}/{kind}"):
            return []
        rows = spark.read.schema("run_id string, TreatmentVal string").parquet(f"{out}/{kind}").collect()
        return sorted((r["run_id"], r["TreatmentVal"]) for r in rows)

    def wait_for(kind, expected):
        until = time.time() + 60
        while named(kind) != expected and time.time() < until:
            time.sleep(0.5)
        assert named(kind) == expected

    write_log(logs, 0, "a", "0.log", deliveries[0][1])
    query = runs.append_live_runs(runs.read_log_files(spark, str(logs)), parents, out, checkpoint, patience=1000)
    try:
        wait_for("unfinished", [("a-0", "1")])
        for delivery, (source, lines) in list(enumerate(deliveries))[1:]:
            write_log(logs, delivery, source, "0.log", lines)
        wait_for("finished", [("a-1", "3"), ("b-0", "2")])
        assert named("unfinished") == [("a-0", "1")]
    finally:
        query.stop()


SCHEMA = "k bigint, j string, v double"


def test_upserts_merge_compact_and_repeat(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k", "j"], SCHEMA, fan_in=3)
    assert table.read().collect() == [] and table.versions() == []
    rng, expected, versions = random.Random(1), {}, {}
    for batch in range(0, 22, 2):
        rows = {(rng.randint(0, 9), rng.choice([None, "a", "b"])): rng.choice([None, 1.5, batch]) for _ in range(5)}
        expected |= rows
        versions[batch] = dict(expected)
        frame = spark.createDataFrame([(*key, None if v is None else float(v)) for key, v in rows.items()], SCHEMA)
        assert table.upsert(frame, batch)
        assert not table.upsert(frame.selectExpr("k", "j", "-1D AS v"), batch)
        if batch % 6 == 4:
            assert {(r["k"], r["j"]): r["v"] for r in table.read().collect()} == expected
    with pytest.raises(ValueError):
        table.upsert(frame, 3)
    assert {(r["k"], r["j"]): r["v"] for r in table.read(4).collect()} == versions[4]
    assert len(table._folders(20)) <= 6
    table.vacuum(keep=1)
    assert table.versions() == [20]
    assert {(r["k"], r["j"]): r["v"] for r in table.read().collect()} == expected
    assert len(os.listdir(tmp_path / "t" / "data")) == len(table._folders(20))


def test_a_batch_that_was_not_committed_is_written_anew(spark, tmp_path, monkeypatch):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], "k bigint, v bigint")
    frame = spark.createDataFrame([(1, 2)], "k bigint, v bigint")

    def dies(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_commit", dies)
        with pytest.raises(RuntimeError):
            table.upsert(frame, 0)
    assert table.versions() == [] and table.upsert(frame, 0)
    assert [tuple(r) for r in table.read().collect()] == [(1, 2)]


def test_last_values_of_a_stream_with_a_repeated_batch(spark, tmp_path):
    src, checkpoint = str(tmp_path / "in"), tmp_path / "ck"
    table = UpsertTable(spark, str(tmp_path / "t"), ["run_id", "var"], live.LAST_VALUES)
    for rows in ([(0, 1, "x = 1"), (0, 2, "y = 2")], [(0, 3, "x = 3"), (1, 1, "x = 9")]):
        spark.createDataFrame(rows, "run_id bigint, seq bigint, line string").write.mode("append").json(src)
        live.upsert_last_values(live.read_live_trace(spark, src), table, str(checkpoint)).awaitTermination()
    expected = {(0, "x", "3", 3), (0, "y", "2", 2), (1, "x", "9", 1)}
    assert set(map(tuple, table.read().collect())) == expected
    last = max((f for f in os.listdir(checkpoint / "commits") if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if (checkpoint / "commits" / name).exists():
            (checkpoint / "commits" / name).unlink()
    live.upsert_last_values(live.read_live_trace(spark, src), table, str(checkpoint)).awaitTermination()
    assert set(map(tuple, table.read().collect())) == expected
