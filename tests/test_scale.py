"""The ways taken by large tables give the same rows as those taken by small ones."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import joins, ranks
from tracewright.session import scratch_path, settle_measured, shared_dir


def skewed(spark, n=3000):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{rng.randint(0, 20)}", i, rng.randint(1, 4)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, at bigint, w bigint")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_range_split_running_total(spark):
    df = skewed(spark)
    plain = ranks.running_total(df, ["key"], ["at"], F.col("w"))
    split = ranks.running_total(df, ["key"], ["at"], F.col("w"), window_rows=100)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))
    assert "_piece" not in split.columns


def test_range_split_without_keys(spark):
    df = skewed(spark)
    got = ranks.running_total(df, [], ["at"], out="no", window_rows=100).orderBy("at").collect()
    assert [r.no for r in got] == list(range(1, 3001))


def test_range_split_with_null_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", 1)], "key string, at bigint")
    got = ranks.running_total(df, ["key"], ["at"], window_rows=10)
    assert sorted(r.upto for r in got.where("key IS NULL").collect()) == list(range(1, 51))


def test_split_median(spark, monkeypatch):
    df = skewed(spark).withColumn("v", F.col("at").cast("double"))
    counts = df.select("key", "v", "w")
    plain = {r.key: r.median for r in ranks.exact_median(counts, ["key"], "v", "w").collect()}
    monkeypatch.setattr(ranks.running_total, "__kwdefaults__", {"rows": None, "window_rows": 100})
    split = {r.key: r.median for r in ranks.exact_median(counts, ["key"], "v", "w").collect()}
    assert plain == split
    hot = sorted(v for k, v, w in ((r.key, r.v, r.w) for r in counts.collect()) if k == "hot" for _ in range(w))
    middle = (hot[(len(hot) - 1) // 2] + hot[len(hot) // 2]) / 2
    assert plain["hot"] == middle


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join(spark, how):
    fact = skewed(spark)
    dim = fact.where("key <> 'k3'").groupBy("key").agg(F.count("*").alias("n"))
    small = joins.attach(fact, dim, ["key"], how)
    large = joins.attach(fact, dim, ["key"], how, broadcast_bytes=0)
    assert "_salt" in plan_of(large) and "_salt" not in plan_of(small)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_salted_join_spreads_rows_without_a_key(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        fact = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, "a").alias("key"))
        dim = spark.createDataFrame([("a", 1)], "key string, n int")
        got = joins.salted_join(fact, dim, ["key"], "left", salts=2)
        rows = got.withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r.id for r in rows}) == len(rows) == 4000 and sum(r.n is not None for r in rows) == 40
    assert len({r.part for r in rows if r.key is None}) == 8


def test_measured_while_written(spark):
    df = skewed(spark)
    settled = settle_measured(df, hot=F.count_if(F.col("key") == "hot"))
    assert settled.rows == 3000 and settled.counts["hot"] == 2000
    assert settled.bytes > 3000 * 16
    assert settled.table.schema == df.schema
    assert settle_measured(df.where("false")).rows == 0


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_path(spark).startswith(shared_dir(spark))
    assert scratch_path(spark) != scratch_path(spark)
