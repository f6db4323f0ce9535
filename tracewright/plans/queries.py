"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import assignments as asg
from ..operators import counterfactual as cf
from ..operators import dataset as ds
from ..operators import definitions as defs
from ..operators import dominance as dom
from ..operators import graphs as gr
from ..operators import long_dataset as lds
from ..operators import models as md
from ..operators import parent_map as pm
from ..operators.joins import attach
from ..session import scratch_path, settle, settle_measured
from ..sources import inputs as rnd
from ..sources import parents as src_parents
from ..sources import records as src_records
from ..sources import traces as src_traces
from ..sources.upserts import UpsertTable
from ..streaming import live, runs
from . import inputs, pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORDER = ["row_id"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(array: Column | str) -> Column:
    return F.array_join(array, ",")


# --- traces and records ---------------------------------------------------------------


@query
def trace_scan(spark, sf_dir):
    path = scratch_path(spark)
    src_traces.write_trace(inputs.trace(spark, sf_dir), path)
    return src_traces.read_trace(spark, path)


@query
def parse_assignments(spark, sf_dir):
    return asg.parse_assignments(inputs.trace(spark, sf_dir))


@query
def core_assignments(spark, sf_dir):
    return asg.core_assignments(asg.parse_assignments(inputs.trace(spark, sf_dir)))


@query
def final_assignments(spark, sf_dir):
    return asg.final_assignments(asg.parse_assignments(inputs.trace(spark, sf_dir)))


@query
def covariate_lookup(spark, sf_dir):
    assignments = asg.parse_assignments(inputs.trace(spark, sf_dir))
    return asg.covariate_lookup(assignments, inputs.parents(spark))


@query
def run_outcomes(spark, sf_dir):
    return asg.run_outcomes(inputs.trace(spark, sf_dir))


@query
def execution_records(spark, sf_dir):
    return asg.execution_records(inputs.trace(spark, sf_dir), inputs.parents(spark))


@query
def live_runs(spark, sf_dir):
    """Records of runs whose logs arrive in three deliveries that cut runs anywhere."""
    landing, out, checkpoint = (scratch_path(spark) for _ in range(3))
    lines = settle(inputs.log_deliveries(spark, sf_dir))
    for delivery in range(3):
        arrived = lines.where(F.col("delivery") == delivery).repartitionByRange("source", "pos")
        arrived.sortWithinPartitions("source", "pos").select("source", "line").write.partitionBy("source").text(
            f"{landing}/{delivery}"
        )
        stream = runs.read_log_files(spark, landing)
        runs.append_live_runs(stream, inputs.parents(spark), out, checkpoint).awaitTermination()
    return spark.read.parquet(f"{out}/finished").drop("batch_id")


@query
def live_last_values(spark, sf_dir):
    """Last values of a trace that arrives in three deliveries; the last batch is merged a second time."""
    landing, path, checkpoint = (scratch_path(spark) for _ in range(3))
    trace = settle(inputs.trace(spark, sf_dir))
    table = UpsertTable(spark, path, ["run_id", "var"], live.LAST_VALUES)
    for delivery in range(3):
        arrived = trace.where(F.pmod(F.xxhash64("run_id", "seq"), F.lit(3)) == delivery)
        arrived.write.mode("append").json(landing)
        live.upsert_last_values(live.read_live_trace(spark, landing), table, checkpoint).awaitTermination()
    table.upsert(table.read().withColumn("value", F.lit("merged twice")), table.versions()[-1])
    return table.read()


@query
def assignment_versions(spark, sf_dir):
    return asg.assignment_versions(asg.parse_assignments(inputs.trace(spark, sf_dir)))


@query
def success_rate(spark, sf_dir):
    return asg.success_rate(asg.run_outcomes(inputs.trace(spark, sf_dir)))


@query
def records_scan(spark, sf_dir):
    path = scratch_path(spark)
    records = inputs.order_records(spark, sf_dir)
    src_records.write_records(
        records.repartitionByRange("row_id").sortWithinPartitions("row_id"), path
    )
    return src_records.read_records(spark, path)


@query
def records_sink(spark, sf_dir):
    path = scratch_path(spark)
    records = inputs.order_records(spark, sf_dir)
    src_records.write_records(records, path, mode="overwrite")
    src_records.write_records(records, path)
    lines = spark.read.text(path).where(F.col("value") != ",".join(fixed.RECORD_COLUMNS))
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query
def parents_scan(spark, sf_dir):
    path = scratch_path(spark)
    mapping = pm.parent_map(pm.assignment_refs(inputs.texts(spark, sf_dir)))
    src_parents.write_parents(mapping, path, key="file")
    return src_parents.read_parents(spark, path)


@query
def parents_sink(spark, sf_dir):
    path = scratch_path(spark)
    mapping = pm.parent_map(pm.assignment_refs(inputs.texts(spark, sf_dir)))
    src_parents.write_parents(mapping, path, key="file")
    return spark.read.text(path)


@query
def dataset_sink(spark, sf_dir):
    path = scratch_path(spark)
    dataset = settle(ds.training_dataset(inputs.order_records(spark, sf_dir), ORDER)).drop("row_id")
    src_records.write_dataset(dataset, path)
    read = src_records.read_dataset(spark, path, dataset.columns)
    return _rounded(read, [*ds.covariate_columns(read), "TreatmentVal"])


@query
def random_inputs(spark, sf_dir):
    drawn = rnd.random_inputs(inputs.table(spark, sf_dir, "customer"), "c_custkey")
    return drawn.select("id", F.col("args")[0].alias("arg"))


# --- scalar rules ---------------------------------------------------------------------


@query
def parse_numeric(spark, sf_dir):
    records = inputs.order_records(spark, sf_dir)
    return records.select(
        "row_id",
        tx.parse_numeric(F.col("TreatmentVal")).alias("value"),
        tx.parse_numeric(F.col("Outcome")).alias("outcome"),
    )


@query
def binarize_outcome(spark, sf_dir):
    records = inputs.order_records(spark, sf_dir)
    return records.select("row_id", tx.binarize_outcome(F.col("Outcome")).alias("outcome"))


@query
def csv_escape(spark, sf_dir):
    texts = inputs.texts(spark, sf_dir)
    return texts.select("file", tx.csv_escape(F.col("text")).alias("field"))


@query
def args_string(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "customer")
    return c.select("c_custkey", tx.args_string(F.array("c_name", "c_mktsegment")).alias("args"))


# --- preprocessing --------------------------------------------------------------------


@query
def parse_covariates(spark, sf_dir):
    return ds.parse_covariates(inputs.order_records(spark, sf_dir), ORDER)


@query
def covariate_types(spark, sf_dir):
    return ds.covariate_types(inputs.order_records(spark, sf_dir), ORDER)


@query
def expand_covariates(spark, sf_dir):
    wide = ds.expand_covariates(inputs.order_records(spark, sf_dir), ORDER)
    # columns are numbers or text as the data has it; shown in long form to compare
    cells = [
        F.struct(
            F.lit(name).alias("key"),
            (F.col(name) if kind == "double" else F.lit(None).cast("double")).alias("num"),
            (F.col(name) if kind == "string" else F.lit(None).cast("string")).alias("text"),
        )
        for name, kind in wide.dtypes
        if name in ds.covariate_columns(wide)
    ]
    return wide.select("row_id", F.explode(F.array(*cells)).alias("c")).select("row_id", "c.*")


@query
def label_encode(spark, sf_dir):
    values = settle(ds.covariate_values(inputs.order_records(spark, sf_dir), ORDER))
    return ds.covariate_codes(values, settle_measured(ds.types_of(values)))


@query
def median_impute(spark, sf_dir):
    wide = ds.expand_covariates(inputs.order_records(spark, sf_dir), ORDER)
    names = _numeric_covariates(wide)
    wide = settle(wide.select("row_id", "TreatmentVar", *names))  # read twice
    group = F.when(F.col("TreatmentVar").isin("status", "total"), "a").otherwise("b")
    values = _cells(wide, names, "row_id", group.alias("grp"))
    return ds.median_impute(values, ["grp", "key"], "value").select("row_id", "key", "value")


def _numeric_covariates(wide: DataFrame) -> list[str]:
    return [name for name in ds.covariate_columns(wide) if wide.schema[name].dataType.typeName() == "double"]


def _cells(wide: DataFrame, names: list[str], *keep: Column | str) -> DataFrame:
    """One row for each of the named columns, beside the columns to keep."""
    cells = [F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names]
    return wide.select(*keep, F.explode(F.array(*cells)).alias("c")).select("*", "c.*").drop("c")


@query
def treatment_types(spark, sf_dir):
    return ds.treatment_types(inputs.order_records(spark, sf_dir))


@query
def treatment_values(spark, sf_dir):
    valued = ds.treatment_values(inputs.order_records(spark, sf_dir), ORDER)
    return valued.select("row_id", "TreatmentVar", F.round("value", 6).alias("value"))


@query
def training_dataset(spark, sf_dir):
    dataset = ds.training_dataset(inputs.order_records(spark, sf_dir), ORDER)
    return _rounded(dataset, [*ds.covariate_columns(dataset), "TreatmentVal"])


@query
def dataset_untidy_names(spark, sf_dir):
    """The dataset in long form: thousands of names, pairs of them equal but for case, and records without a variable."""
    dataset = lds.long_dataset(inputs.untidy_records(spark, sf_dir), ORDER)
    cells = attach(dataset.cells, dataset.names.select("no", "key"), ["no"])
    rows = dataset.rows.select("row_id", "TreatmentVar", F.round("TreatmentVal", 6).alias("TreatmentVal"), "Outcome")
    return cells.join(rows, "row_id").select(*rows.columns, "key", "value")


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


@query
def preview(spark, sf_dir):
    records = inputs.order_records(spark, sf_dir)
    return ds.preview(records, ORDER)


@query
def dataset_profile(spark, sf_dir):
    return ds.dataset_profile(inputs.order_records(spark, sf_dir), ORDER)


@query
def per_test_aggregate(spark, sf_dir):
    result = ds.per_test_aggregate(inputs.order_records(spark, sf_dir), ORDER)
    return _rounded(result, ["TreatmentVal"])


# --- models and counterfactuals -------------------------------------------------------


@query
def treatment_vars(spark, sf_dir):
    return md.treatment_vars(inputs.numeric_dataset(spark, sf_dir))


@query
def treatment_counts(spark, sf_dir):
    return md.treatment_counts(inputs.numeric_dataset(spark, sf_dir))


@query
def class_cardinality(spark, sf_dir):
    return md.class_cardinality(ds.training_dataset(inputs.order_records(spark, sf_dir), ORDER))


@query
def constant_models(spark, sf_dir):
    # one model per variable and value; most values have only one outcome
    records = inputs.order_records(spark, sf_dir)
    by_value = records.withColumn("TreatmentVar", F.concat_ws("=", "TreatmentVar", "TreatmentVal"))
    typed = by_value.select(
        "TreatmentVar", tx.binarize_outcome(F.col("Outcome")).alias("Outcome")
    )
    return md.constant_models(typed).select("treatment_var", "kind", "const_class")


@query
def models_missing(spark, sf_dir):
    return md.models_missing(inputs.numeric_dataset(spark, sf_dir), inputs.linear_models(spark))


def _fitted_on(spark, sf_dir):
    # lines are written, not four rows of each; no model reads the tests' names, a good part of a line
    return inputs.treatments_of(settle(inputs.numeric_lines(spark, sf_dir, spread_out=True).drop("TestArgs")))


@query
def fit_models(spark, sf_dir):
    return md.fit_models(_fitted_on(spark, sf_dir))


@query
def fitted_models(spark, sf_dir):
    """What is fitted, and what holds where the objective is least: no gradient, and scores as high as outcomes on average."""
    dataset = _fitted_on(spark, sf_dir)
    models = md.fit_models(dataset)
    checked = models.join(md.fit_residuals(dataset, models), "treatment_var", "left")
    return checked.select(
        "treatment_var",
        "kind",
        "const_class",
        _joined("features").alias("features"),
        F.round("residual", 6).alias("residual"),
        F.round("mean_score", 6).alias("mean_score"),
    )


@query
def fit_forest(spark, sf_dir):
    dataset = _fitted_on(spark, sf_dir)
    names = [r.treatment_var for r in md.treatment_vars(dataset).orderBy("treatment_var").collect()]
    forests = md.fit_forest(dataset, names, numTrees=5, maxDepth=4)
    return cf.ranking(cf.suspiciousness(cf.score_forest(dataset, forests)))


@query
def coerce_rows(spark, sf_dir):
    entries = [F.split_part("Covariates", F.lit(";"), F.lit(at)) for at in (1, 2)]
    raw = inputs.order_records(spark, sf_dir).withColumns(
        {f"cov_{n}": F.split_part(e, F.lit("="), F.lit(2)) for n, e in zip(("first", "second"), entries)}
    )
    coerced = cf.coerce_rows(raw)
    return coerced.select("row_id", "TreatmentVar", "TreatmentVal", "Outcome", "cov_first", "cov_second")


@query
def covariate_means(spark, sf_dir):
    means = md.covariate_means(inputs.numeric_dataset(spark, sf_dir))
    return _rounded(means, [c for c in means.columns if c != "treatment_var"])


@query
def fill_covariates(spark, sf_dir):
    wide = ds.expand_covariates(inputs.order_records(spark, sf_dir), ORDER)
    names = _numeric_covariates(wide)
    filled = md.fill_covariates(settle(wide.select("row_id", "TreatmentVar", *names)))  # read twice
    return _rounded(_cells(filled, names, "row_id", "TreatmentVar"), ["value"])


@query
def representative_values(spark, sf_dir):
    reps = cf.representative_values(inputs.numeric_dataset(spark, sf_dir))
    return reps.select("treatment_var", F.explode("reps").alias("rep"))


@query
def counterfactual_grid(spark, sf_dir):
    dataset = inputs.numeric_dataset(spark, sf_dir)
    grid = cf.counterfactual_grid(dataset, cf.representative_values(dataset))
    return grid.select("TestArgs", "TreatmentVar", "TreatmentVal", "rep")


@query
def predict_grid_linear(spark, sf_dir):
    dataset = inputs.numeric_dataset(spark, sf_dir)
    grid = cf.predict_grid(dataset, inputs.linear_models(spark))
    return grid.select("TestArgs", "TreatmentVar", "TreatmentVal", "rep", "predicted")


def _averages(spark, sf_dir):
    return cf.avg_outcome_by_rep(
        inputs.numeric_dataset(spark, sf_dir), inputs.linear_models(spark)
    )


@query
def avg_outcome_by_rep(spark, sf_dir):
    return _rounded(_averages(spark, sf_dir), ["avg_outcome"])


@query
def suspiciousness_linear(spark, sf_dir):
    return _rounded(cf.suspiciousness(_averages(spark, sf_dir)), ["score"])


@query
def ranking(spark, sf_dir):
    return _rounded(cf.ranking(cf.suspiciousness(_averages(spark, sf_dir))), ["score"])


def _spread(spark, sf_dir):
    """Score per customer nation and segment: the spread of its account balances."""
    c = inputs.table(spark, sf_dir, "customer")
    name = F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment")
    averages = c.select(name.alias("treatment_var"), (F.col("c_acctbal") / 10000).alias("avg_outcome"))
    return cf.suspiciousness(averages)


@query
def ranking_top10(spark, sf_dir):
    return _rounded(cf.ranking_top(_spread(spark, sf_dir)), ["score"])


@query
def ranking_format(spark, sf_dir):
    return cf.ranking_lines(cf.suspiciousness(_averages(spark, sf_dir)))


@query
def fault_ranking(spark, sf_dir):
    return pipeline.rank_trace(inputs.trace(spark, sf_dir), inputs.parents(spark))


# --- graphs ---------------------------------------------------------------------------


def _graph(spark, sf_dir):
    return (
        settle(inputs.session_nodes(spark, sf_dir)),
        settle(inputs.session_edges(spark, sf_dir)),
    )


@query
def edges_distinct(spark, sf_dir):
    edges = inputs.session_edges(spark, sf_dir)
    return gr.edges_distinct(edges.unionByName(edges))


@query
def adjacency(spark, sf_dir):
    near = gr.adjacency(inputs.session_nodes(spark, sf_dir), inputs.session_edges(spark, sf_dir))
    return near.select(
        "graph_id",
        "node",
        _joined("predecessors").alias("predecessors"),
        _joined("successors").alias("successors"),
    )


@query
def branch_nodes(spark, sf_dir):
    return gr.branch_nodes(inputs.session_edges(spark, sf_dir))


@query
def terminal_nodes(spark, sf_dir):
    return gr.terminal_nodes(
        inputs.session_nodes(spark, sf_dir), inputs.session_edges(spark, sf_dir)
    )


@query
def virtual_entry(spark, sf_dir):
    _, edges = gr.virtual_entry(
        inputs.session_nodes(spark, sf_dir), inputs.session_edges(spark, sf_dir)
    )
    return edges


@query
def call_site_edges(spark, sf_dir):
    return gr.call_site_edges(inputs.program_nodes(spark, sf_dir))


@query
def subgraph_edges(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    ends = gr.terminal_nodes(nodes, edges)
    members = nodes.join(ends, ["graph_id", "node"], "left_anti")
    return gr.subgraph_edges(edges, members)


@query
def dot_lines(spark, sf_dir):
    lines = gr.dot_lines(inputs.session_nodes(spark, sf_dir), inputs.session_edges(spark, sf_dir))
    return lines.select("graph_id", "section", "line")


@query
def reachable(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    # from each graph's first event type, not from its start
    return gr.reachable(edges, nodes.where("ord = 1").select("graph_id", "node"))


def _dominators(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return nodes, settle(dom.dominators(edges, inputs.session_starts(nodes)))


@query
def dominators(spark, sf_dir):
    return _dominators(spark, sf_dir)[1]


def _immediate_dominators(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    tree = dom.dominance_tree(edges, inputs.session_starts(nodes))
    return nodes.select("graph_id", "node").join(tree, ["graph_id", "node"], "left")


@query
def immediate_dominators(spark, sf_dir):
    return _immediate_dominators(spark, sf_dir)


@query
def dominator_tree(spark, sf_dir):
    return dom.dominator_tree(_immediate_dominators(spark, sf_dir))


@query
def dominator_listing(spark, sf_dir):
    return dom.dominator_listing(_dominators(spark, sf_dir)[1])


@query
def postdominators(spark, sf_dir):
    return dom.postdominators(*_graph(spark, sf_dir))


@query
def immediate_postdominators(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    tree = dom.postdominance_tree(nodes, edges)
    return nodes.select("graph_id", "node").join(tree, ["graph_id", "node"], "left")


@query
def control_dependence(spark, sf_dir):
    return dom.control_dependence(*_graph(spark, sf_dir))


def _deep(spark, sf_dir):
    nodes, edges = inputs.deep_graphs(spark, sf_dir)
    return settle(nodes), settle(edges)


@query
def deep_dominator_tree(spark, sf_dir):
    """Immediate dominators in graphs of a thousand nodes in a chain, with back edges."""
    nodes, edges = _deep(spark, sf_dir)
    return dom.dominance_tree(edges, inputs.session_starts(nodes))


@query
def deep_postdominator_tree(spark, sf_dir):
    return dom.postdominance_tree(*_deep(spark, sf_dir))


@query
def deep_control_dependence(spark, sf_dir):
    return dom.control_dependence(*_deep(spark, sf_dir))


@query
def label_versions(spark, sf_dir):
    return defs.label_versions(inputs.session_nodes(spark, sf_dir))


@query
def gen_kill(spark, sf_dir):
    made = defs.gen_kill(inputs.session_nodes(spark, sf_dir))
    return made.withColumn("gen", _joined(F.transform("gen", lambda v: v.cast("string"))))


@query
def reaching_definitions(spark, sf_dir):
    return defs.reaching_definitions(*_graph(spark, sf_dir))


def _names(spark, sf_dir):
    """Versioned names: the part's line numbers and, for some, a second number."""
    lines = inputs.table(spark, sf_dir, "lineitem")
    number = F.concat_ws("_", F.col("l_returnflag"), F.col("l_linenumber").cast("string"))
    twice = F.concat_ws("_", number, (F.col("l_suppkey") % 10).cast("string"))
    name = F.when(F.col("l_partkey") % 2 == 0, number).otherwise(twice)
    return lines.select(F.col("l_orderkey").alias("file"), name.alias("name")).distinct()


@query
def base_names(spark, sf_dir):
    return defs.base_names(_names(spark, sf_dir).select("name").distinct())


@query
def max_versions(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders")
    variables = [f"{flag}{end}" for flag in "ANR" for end in ("", *(f"_{n}" for n in range(1, 8)))]
    wanted = orders.select(
        F.col("o_orderkey").alias("file"), F.explode(F.array(*map(F.lit, variables))).alias("var")
    )
    return defs.max_versions(_names(spark, sf_dir), wanted, ["file"])


@query
def assignment_refs(spark, sf_dir):
    found = pm.assignment_refs(inputs.texts(spark, sf_dir))
    return found.withColumn("refs", _joined("refs"))


@query
def parent_map(spark, sf_dir):
    mapping = pm.parent_map(pm.assignment_refs(inputs.texts(spark, sf_dir)))
    return mapping.withColumn("refs", _joined("refs"))
