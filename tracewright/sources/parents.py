"""Parent maps as JSON: variable to list of parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARENTS_SCHEMA = "var string, pos int, parent string"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_parents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``(var, pos, parent)`` of JSON maps, one object per line.

    ``multi_line=True`` takes each file as one object, as a single program's
    map is written. A missing path gives no rows; several objects add up.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], PARENTS_SCHEMA)
    maps = spark.read.text(path, wholetext=multi_line).select(
        F.from_json("value", "map<string,array<string>>").alias("map")
    )
    lists = maps.select(F.explode("map").alias("var", "list"))
    return lists.select("var", F.posexplode("list").alias("pos", "parent"))


def write_parents(mapping: DataFrame, path: str, key: str | None = None) -> None:
    """Write ``(var, refs)`` as JSON maps, one object per line.

    Without ``key`` each variable is an object of its own and nothing is
    shuffled. With ``key``, a column such as the source file, the variables of
    one value share an object, as in one map file per program.
    """
    if key is None:
        entries = F.create_map("var", "refs")
        objects = mapping.select(F.to_json(entries).alias("value"))
    else:
        entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("var", "refs"))))
        objects = mapping.groupBy(key).agg(F.to_json(entries).alias("value"))
    objects.select("value").write.mode("overwrite").text(path)
