"""Where intermediate tables live, and the session settings the engine expects."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is made only for a ``local`` master without the
    setting; a cluster without it is an error, because a table written to one
    machine's disk is lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewright-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A new, unused path below the shared folder, grouped by application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tracewright/{app}/{uuid.uuid4().hex}"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs of the block delete their shuffle files when they end: what they wrote is read from the table from then on."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


class Settled(NamedTuple):
    """A written table with what was counted while writing it."""

    table: DataFrame
    rows: int
    bytes: int
    counts: dict


def settle_measured(df: DataFrame, **counts: Column) -> Settled:
    """Write ``df`` as a shared parquet table, counting as it is written.

    Gives a scan of the table, its rows, an upper estimate of its size in memory
    and the aggregates in ``counts``. The written table cuts lineage, survives
    the loss of executors and keeps column pruning for whoever reads it.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    seen = Observation()
    measured = df.observe(
        seen,
        F.count(F.lit(1)).alias("_rows"),
        F.sum(row_bytes(df)).alias("_bytes"),
        *[c.alias(name) for name, c in counts.items()],
    )
    with _shuffles_freed(spark):
        measured.write.parquet(path)
    found = seen.get
    table = spark.read.schema(df.schema).parquet(path)
    return Settled(table, found["_rows"], found["_bytes"] or 0, found)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a shared parquet table and return a scan of it."""
    path = scratch_path(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read any more, so that long jobs do not keep all of theirs on disk.

    Results that are not computed yet must not read them: settle those first.
    """
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/tracewright/" not in folder:
                raise ValueError(f"{folder} is not a settled table")
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def partitioned_by(df: DataFrame, keys: list[str]) -> Iterator[DataFrame]:
    """``df`` hash-partitioned and sorted by ``keys``, kept for the length of the block.

    Rounds that join on ``keys`` then move only their own rows. Partitions of a
    lost executor are made again from ``df``, so pass a settled table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.repartition(parts, *keys).sortWithinPartitions(*keys)
    kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def row_bytes(df: DataFrame) -> Column:
    """Upper estimate of a row's size in memory."""
    width = F.lit(0).cast("bigint")
    for field in df.schema:
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(F.struct(F.col(f"`{field.name}`")))
            width = width + 64 + F.coalesce(F.octet_length(text) * 8, F.lit(0))
        elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + 32 + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        else:
            width = width + 16
    return width


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table this application has settled."""
    root = f"{shared_dir(spark)}/tracewright/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
