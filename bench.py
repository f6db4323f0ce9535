"""Time the headline queries at ``$BENCH_SF_DIR`` and print one JSON line.

Each query is built and written to a sink that keeps nothing, so every row is
computed. Times are the better of ``$BENCH_REPEATS`` runs (default 2).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tracewright.plans.queries import QUERIES
from tracewright.session import RECOMMENDED_CONF, drop_scratch

HEADLINE = [
    "trace_scan",
    "execution_records",
    "records_scan",
    "covariate_types",
    "label_encode",
    "median_impute",
    "training_dataset",
    "representative_values",
    "counterfactual_grid",
    "suspiciousness_linear",
    "ranking",
    "fit_models",
    "fault_ranking",
    "reachable",
    "dominators",
    "immediate_dominators",
    "postdominators",
    "control_dependence",
    "reaching_definitions",
    "assignment_refs",
    "parent_map",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracewright-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # start the readers and the code generator before timing
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()

    times = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(f"{name}: {runs}", file=sys.stderr, flush=True)
    drop_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "repeats": repeats,
            }
        )
    )


if __name__ == "__main__":
    main()
