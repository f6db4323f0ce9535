"""Streams of trace lines and of finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.assignments import execution_records, parse_assignments
from ..sources.traces import TRACE_SCHEMA, split_runs
from ..sources.upserts import UpsertTable


LAST_VALUES = "run_id bigint, var string, value string, seq bigint"


def read_live_trace(spark: SparkSession, path: str) -> DataFrame:
    """Stream of ``(run_id, seq, line)`` from JSON files arriving in ``path``."""
    return spark.readStream.schema(TRACE_SCHEMA).json(path)


def running_last_values(trace: DataFrame) -> DataFrame:
    """Last value so far of every variable of every run, for complete or update mode."""
    return (
        parse_assignments(trace)
        .groupBy("run_id", "var")
        .agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    )


def upsert_last_values(trace: DataFrame, table: UpsertTable, checkpoint: str) -> StreamingQuery:
    """Keep ``table`` (``run_id, var, value, seq`` by run and variable) at the last values of a streamed trace.

    Only values that changed are merged; a batch that is run again after a failure leaves the table as it is.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        if not table.upsert(batch, batch_id):
            # the batch's state is committed only if its rows are computed
            batch.write.format("noop").mode("overwrite").save()

    return (
        running_last_values(trace)
        .writeStream.outputMode("update")
        .foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_finished_runs(
    spark: SparkSession, logs: str, parents: DataFrame, out: str, checkpoint: str
) -> StreamingQuery:
    """Turn log files of finished runs into records as they arrive.

    Each file holds whole runs, closed by separators. A batch writes its own
    ``batch_id`` folder and replaces it when the batch is run again, so no run
    is recorded twice. Run ids go on at a new multiple of 2^40 in each batch.
    """
    lines = spark.readStream.text(logs).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("at", F.monotonically_increasing_id())
        runs = split_runs(placed).withColumn("run_id", F.col("run_id") + F.lit(batch_id << 40))
        records = execution_records(runs, parents)
        records.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
