"""Runs put together from log files that arrive piece by piece.

Every source writes one log after another into a folder ``source=<name>``; a run ends at a separator line, in whatever
file and batch that comes. Files are first cut at separators where they are read, and each piece is reduced to the first
and the last line of each variable, which is all that records need. The state of a source is the same summary of its run
that has not ended, so it grows with the run's variables and not with its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..functions.text import trim_control
from ..operators.assignments import execution_records
from ..session import settle_measured

PIECES = (
    "source string, file string, block bigint, piece bigint, var string, "
    "first_at bigint, first_line string, last_at bigint, last_line string, lines bigint, closes boolean"
)
RUNS = "source string, run_no bigint, seq bigint, line string, finished boolean"
OPEN_RUN = (
    "run_no bigint, lines bigint, vars array<string>, "
    "first_at array<bigint>, first_line array<string>, last_at array<bigint>, last_line array<string>"
)


def read_log_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of ``(source, file, block, line)`` of the files in the folders ``source=<name>`` below each folder of ``path``."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    file = F.col("_metadata.file_path")
    return reader.text(f"{path}/*/source=*").select(
        F.regexp_extract(file, "source=([^/]*)", 1).alias("source"),
        file.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def log_pieces(lines: DataFrame) -> DataFrame:
    """Each split of a file cut at separators: a row for each piece and variable, and one (``var`` null) for the piece.

    Positions count a piece's lines from 1. ``closes`` marks pieces that a separator ends.
    """
    named = (F.instr("line", "=") > 0) & ~trim_control(F.col("line")).startswith(fixed.SEPARATOR_PREFIX)
    # only lines that begin with it state the outcome, so their first one is kept apart
    outcome = F.when(F.col("line").startswith(fixed.OUTCOME_PREFIX), F.lit("=")).otherwise(F.lit(""))
    rows = lines.select(
        "source",
        "file",
        "block",
        F.when(named, F.concat(outcome, trim_control(F.substring_index("line", "=", 1)))).alias("var"),
        "line",
        (F.col("line") == fixed.SEPARATOR_LINE).alias("closes"),
    )

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PIECES.split(", ")])
        place, piece, lines, seen, out = None, 0, 0, {}, []

        def end(closes: bool) -> None:
            out.extend([*place, piece, var, *found, 0, False] for var, found in seen.items())
            out.append([*place, piece, None, None, None, None, None, lines, closes])

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in parts:
            for row in zip(*(batch[c].to_pylist() for c in ("source", "file", "block", "var", "line", "closes"))):
                if row[:3] != place:
                    if lines:
                        end(False)
                    place, piece, lines, seen = row[:3], 0, 0, {}
                _, _, _, var, line, closes = row
                if closes:
                    end(True)
                    piece, lines, seen = piece + 1, 0, {}
                    continue
                lines += 1
                if var is not None:
                    found = seen.setdefault(var, [lines, line, lines, line])
                    found[2:] = lines, line
            if out:
                yield batch_of()
                out.clear()
        if lines:
            end(False)
        if out:
            yield batch_of()

    return rows.mapInArrow(task, PIECES)


def _run_rows(source: str, run_no: int, run: dict[str, list], finished: bool) -> list[tuple]:
    out = []
    for first_at, first_line, last_at, last_line in run.values():
        out.append((source, run_no, first_at, first_line, finished))
        if last_at != first_at:
            out.append((source, run_no, last_at, last_line, finished))
    return out


def assemble_runs(pieces: DataFrame, patience: int | None = None) -> DataFrame:
    """``(source, run_no, seq, line, finished)`` of ended runs, each reduced to the first and last line of every variable.

    Runs of a source are numbered from 0 in the order of their files' names inside a batch; ``seq`` counts all lines of a run from 1.
    A source that is silent for ``patience`` milliseconds gives up its open run, with ``finished`` false; what comes later of it
    is a new run. Without ``patience`` an open run waits.
    """
    names = [c.split()[0] for c in RUNS.split(", ")]

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run_no, lines, *kept = state.get if state.exists else (0, 0, [], [], [], [], [])
        run = {v: list(f) for v, *f in zip(*kept)}
        out = []
        if state.hasTimedOut:
            if run:
                out += _run_rows(key[0], run_no, run, False)
                run_no += 1
            lines, run = 0, {}
        else:
            found = pd.concat(list(parts)).sort_values(["file", "block", "piece", "lines"], kind="stable")
            columns = ["var", "first_at", "first_line", "last_at", "last_line", "lines", "closes"]
            for var, first_at, first_line, last_at, last_line, n, closes in zip(*(found[c].tolist() for c in columns)):
                if isinstance(var, str):
                    known = run.setdefault(var, [lines + int(first_at), first_line, 0, None])
                    known[2:] = lines + int(last_at), last_line
                    continue
                lines += int(n)
                if closes:
                    out += _run_rows(key[0], run_no, run, True)
                    run_no, lines, run = run_no + 1, 0, {}
        summary = [list(run), *([r[i] for r in run.values()] for i in range(4))]
        state.update((run_no, lines, *summary))
        if patience is not None and run:
            state.setTimeoutDuration(patience)
        if out:
            yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.NoTimeout if patience is None else GroupStateTimeout.ProcessingTimeTimeout
    return pieces.groupBy("source").applyInPandasWithState(update, RUNS, OPEN_RUN, "append", timeout)


def append_live_runs(
    logs: DataFrame, parents: DataFrame, out: str, checkpoint: str, patience: int | None = None
) -> StreamingQuery:
    """Write the records of each run when it ends, below ``out/finished``; those of runs given up go to ``out/unfinished``.

    A batch replaces its own folder when it is run again, so no run is recorded twice. The run's id is ``<source>-<run_no>``.
    The query ends when all files there are have been read; with ``patience`` it goes on, since time must pass.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        named = batch.withColumn("run_id", F.concat_ws("-", "source", F.col("run_no").cast("string")))
        runs = settle_measured(named, given_up=F.count_if(~F.col("finished")))
        for name, wanted in (("finished", True), ("unfinished", False)):
            if runs.counts["given_up"] < runs.rows if wanted else runs.counts["given_up"]:
                some = runs.table.where(F.col("finished") == wanted).select("run_id", "seq", "line")
                records = execution_records(some, parents)
                records.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")

    runs = assemble_runs(log_pieces(logs), patience)
    return (
        runs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"availableNow": True} if patience is None else {"processingTime": f"{patience} milliseconds"}))
        .start()
    )
