"""Traces, records and graphs made from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import args_string
from ..operators.assignments import append_outcomes
from ..operators.graphs import union_all
from ..operators.models import CONSTANT, LOGISTIC, MODEL_SCHEMA
from ..operators.ranks import running_total
from ..session import settle
from ..sources.parents import PARENTS_SCHEMA

# Order of a record made from one order row; see ``order_records``.
SLOTS = 5
CHUNK = 65_536

PARENTS = [
    ("purchase", 0, "temp_view"),
    ("purchase", 1, "click"),
    ("click", 0, "signup"),
    ("click", 1, "refund"),
]

LINE_NUMBERS = ["quantity", "discount", "tax", "extendedprice"]
LINEAR_FEATURES = ["cov_discount", "cov_extendedprice", "cov_quantity", "cov_tax", "TreatmentVal"]
LINEAR_MODELS = [
    ("quantity", LOGISTIC, None, LINEAR_FEATURES, [8.0, -0.00002, 0.0, 5.0, 0.05], -1.0),
    ("discount", LOGISTIC, None, LINEAR_FEATURES, [0.0, 0.00003, -0.04, 3.0, 10.0], -0.9),
    ("extendedprice", CONSTANT, 1, LINEAR_FEATURES, None, None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a scan of fewer splits than cores; larger scans stay as they are.

    For tables whose rows are dear to read apart (bags, texts); a plain scan is
    faster left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARENTS, PARENTS_SCHEMA)


def linear_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINEAR_MODELS, MODEL_SCHEMA)


def user_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, seq, error)``: a user's run fails when its last event has an even ``k``."""
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int")
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        (F.max("event_id") + 1).alias("seq"), F.max_by(k, "event_id").alias("k")
    )
    return last.select("run_id", "seq", F.when(F.col("k") % 2 == 0, "failed").alias("error"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user: an assignment per event, then the outcome line."""
    kind = F.col("event_type")
    var = F.when(kind == "view", "temp_view").when(kind == "error", "error_debug").otherwise(kind)
    lines = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.format_string("%s = %.2f", var, F.col("value")).alias("line"),
    )
    return append_outcomes(lines, user_status(spark, sf_dir))


def log_deliveries(spark: SparkSession, sf_dir: str, deliveries: int = 3, sources: int = 4) -> DataFrame:
    """``(delivery, source, pos, line)``: the trace as log lines of several sources, delivered in equal parts.

    A source writes its runs one after the other, each closed by the separator; a delivery ends wherever it does.
    """
    rows = trace(spark, sf_dir).select("run_id", "seq", "line", F.lit(0).alias("closing"))
    closing = rows.groupBy("run_id").agg(F.max("seq").alias("seq")).select(
        "run_id", "seq", F.lit(fixed.SEPARATOR_LINE).alias("line"), F.lit(1).alias("closing")
    )
    lines = settle(rows.unionByName(closing).withColumn("source", F.pmod("run_id", F.lit(sources))))
    placed = running_total(lines, ["source"], ["run_id", "seq", "closing"], out="pos")
    totals = lines.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    cut = F.expr(f"int((pos - 1) * {deliveries} div n)").alias("delivery")
    return placed.join(F.broadcast(totals), "source").select(cut, "source", "pos", "line")


def numeric_lines(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """Order lines with the four numbers that are treatments, and their order's outcome.

    ``spread_out`` spreads lines over all cores before the join, for who writes them: the splits of a join cannot be
    counted without running it.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        (F.col("o_orderstatus") == "F").cast("int").alias("Outcome"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *[f"l_{n}" for n in LINE_NUMBERS])
    lines = (spread(lines) if spread_out else lines).join(orders, "l_orderkey")
    return lines.withColumn("TestArgs", F.col("l_orderkey").cast("string")).drop("l_orderkey")


def numeric_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four treatments per order line, each with the other three as covariates."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("var"), F.col(f"l_{n}").alias("val")) for n in LINE_NUMBERS])
    )
    rows = numeric_lines(spark, sf_dir).select("*", pairs.alias("t"))
    return rows.select(
        "TestArgs",
        *[
            F.when(F.col("t.var") != n, F.col(f"l_{n}")).alias(f"{fixed.COVARIATE_PREFIX}{n}")
            for n in sorted(LINE_NUMBERS)
        ],
        F.col("t.var").alias("TreatmentVar"),
        F.col("t.val").alias("TreatmentVal"),
        "Outcome",
    )


def treatments_of(lines: DataFrame) -> DataFrame:
    """The rows of ``numeric_dataset`` from settled ``numeric_lines``, with or without ``TestArgs``.

    One treatment after the other, so that who asks for one reads each line once.
    """
    return union_all(
        [
            lines.select(
                *[c for c in lines.columns if c == "TestArgs"],
                *[
                    (F.lit(None).cast("double") if n == var else F.col(f"l_{n}")).alias(f"{fixed.COVARIATE_PREFIX}{n}")
                    for n in sorted(LINE_NUMBERS)
                ],
                F.lit(var).alias("TreatmentVar"),
                F.col(f"l_{var}").alias("TreatmentVal"),
                "Outcome",
            )
            for var in LINE_NUMBERS
        ]
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five text records per order, ordered by ``row_id``, with untidy bags."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
    o = spread(table(spark, sf_dir, "orders").select(*columns, "o_orderdate"))
    cust = F.col("o_custkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    month = F.month("o_orderdate").cast("string")
    total = F.format_string("%.2f", F.col("o_totalprice"))
    shown = F.when(cust % 5 == 0, fixed.MISSING_PARENT).otherwise(total)
    failed = status == "F"
    words = F.array(
        F.when(failed, "pass").otherwise("fail"),
        F.when(failed, "1").otherwise("0"),
        F.when(failed, " TRUE ").otherwise("False"),
    )

    def record(slot: int, var: str, value: Column, *bag: Column | str) -> Column:
        parts = [F.lit(b) if isinstance(b, str) else b for b in bag]
        return F.struct(
            F.lit(slot).alias("slot"),
            F.lit(var).alias("var"),
            value.alias("value"),
            F.concat(*parts).alias("bag"),
        )

    again = F.when(cust % 3 == 0, ";priority=N/A").otherwise("")
    made = F.array(
        record(0, "status", status, "priority=", priority, ";month=", month),
        record(1, "priority", priority, "month=", month, ";total=", shown),
        record(
            2, "total", F.when(cust % 11 == 0, "NaN").otherwise(total),
            " status = ", status, " ;priority=", priority, again,
        ),
        record(3, "Outcome", F.when(failed, "1").otherwise("0"), ""),
        record(
            4, "month", F.concat(month, F.lit(" ")),
            "total=", shown, "=;=x;bad;a==b;c=;cust=", (cust % 7).cast("string"),
        ),
    )
    rows = o.select("o_orderkey", "o_custkey", words.alias("words"), F.explode(made).alias("r"))
    return rows.select(
        (F.col("o_orderkey") * SLOTS + F.col("r.slot")).alias("row_id"),
        args_string(F.array(cust.cast("string"), (cust % 7).cast("string"))).alias("TestArgs"),
        F.col("r.bag").alias("Covariates"),
        F.col("r.var").alias("TreatmentVar"),
        F.col("r.value").alias("TreatmentVal"),
        F.get("words", (cust % 3).cast("int")).alias("Outcome"),
    )


def untidy_records(spark: SparkSession, sf_dir: str, pairs: int = 3000) -> DataFrame:
    """A record per event: ``pairs`` numeric covariates and as many texts whose names differ from theirs in case only,
    two variables that do so, and records without a variable."""
    at = F.col("event_id")
    no = (at % pairs).cast("string")
    number = F.when((at >= pairs) & (at % 11 == 0), F.lit("N/A")).otherwise((at % 7).cast("string"))
    word = F.floor(at / pairs) % 3
    bag = F.concat(F.lit("n"), no, F.lit("="), number, F.lit(";N"), no, F.lit("=c"), word.cast("string"))
    kind = F.col("event_type")
    var = F.when(kind == "view", "Price").when(kind == "click", "price").when(kind != "error", kind)
    text = F.when(kind == "click", F.concat(F.lit("c"), (at % 5).cast("string")))
    value = F.when(at % 13 != 0, F.format_string("%.2f", F.col("value")))
    return table(spark, sf_dir, "events").select(
        at.alias("row_id"),
        F.col("user_id").cast("string").alias("TestArgs"),
        bag.alias("Covariates"),
        var.alias("TreatmentVar"),
        F.coalesce(text, value).alias("TreatmentVal"),
        (at % 2).cast("string").alias("Outcome"),
    )


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the graph of their user and two-day span."""
    span = F.floor(F.unix_date(F.to_date("ts")) / 2)
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), span.cast("string")).alias("graph_id"),
        "event_id",
        F.col("event_type").alias("node"),
    )


def session_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct steps from event type to event type, with start and end.

    Consecutive events are paired inside chunks of event ids, so no window holds
    more than a chunk; one summary row per chunk then joins chunk to chunk.
    """
    events = _sessions(spark, sf_dir).withColumn("chunk", F.floor(F.col("event_id") / CHUNK))
    inside = Window.partitionBy("graph_id", "chunk").orderBy("event_id")
    steps = events.select(
        "graph_id", F.col("node").alias("src"), F.lead("node").over(inside).alias("dst")
    ).where("dst IS NOT NULL")
    chunks = events.groupBy("graph_id", "chunk").agg(
        F.min_by("node", "event_id").alias("head"), F.max_by("node", "event_id").alias("tail")
    )
    across = Window.partitionBy("graph_id").orderBy("chunk")
    linked = chunks.select(
        "graph_id",
        "head",
        "tail",
        F.lead("head").over(across).alias("after"),
        F.lag("tail").over(across).alias("before"),
    )
    return union_all(
        [
            steps,
            linked.select(
                "graph_id", F.col("tail").alias("src"), F.coalesce("after", F.lit("end")).alias("dst")
            ),
            linked.where("before IS NULL").select(
                "graph_id", F.lit("start").alias("src"), F.col("head").alias("dst")
            ),
        ]
    ).distinct()


def session_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each graph, labelled like statements, with start and end.

    ``r`` is the rank of the type's first event in the graph, ``m`` its count.
    """
    seen = _sessions(spark, sf_dir).groupBy("graph_id", "node").agg(
        F.min("event_id").alias("first"), F.count(F.lit(1)).alias("m")
    )
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("first"))
    ranked = seen.select("graph_id", "node", "m", rank.alias("r"))
    kind, r, m = F.col("node"), F.col("r"), F.col("m")
    label = (
        F.when(kind == "view", F.format_string("for-cond: page_%d <= page_%d", r, m))
        .when(kind == "click", F.format_string("page_%d = click(page_%d)", r, m))
        .when(kind == "signup", F.format_string("account_%d = signup(account_%d, page_%d)", r, m, r))
        .when(kind == "purchase", F.format_string("Return purchase(account_%d)", r))
        .otherwise(F.format_string('throw "error_%d"', m))
    )
    graphs = ranked.select("graph_id").distinct()

    def fixed_node(node: str, text: str, ord_: int) -> DataFrame:
        return graphs.select(
            "graph_id", F.lit(node).alias("node"), F.lit(text).alias("label"), F.lit(ord_).alias("ord")
        )

    return union_all(
        [
            ranked.select("graph_id", "node", label.alias("label"), r.alias("ord")),
            fixed_node("start", f"{fixed.METHOD_START} main", 0),
            fixed_node("end", f"{fixed.METHOD_END} main", 1_000_000),
        ]
    )


def deep_graphs(spark: SparkSession, sf_dir: str, size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graphs that are a chain of ``size`` events each, with ways round and back.

    The fourth of every ten nodes also leads to the eighth, errors back to the first of their ten and refunds
    to the first of their hundred.
    """
    events = table(spark, sf_dir, "events").select("event_id", "event_type").withColumn("p", F.col("event_id") % size)
    graph = F.floor(F.col("event_id") / size).cast("string").alias("graph_id")
    last = events.agg(F.max("event_id")).first()[0]
    ends = (F.col("p") == size - 1) | (F.col("event_id") == last)
    label = (
        F.when(F.col("p") == 0, F.lit(f"{fixed.METHOD_START} main"))
        .when(ends, F.lit(f"{fixed.METHOD_END} main"))
        .otherwise(F.col("event_type"))
    )
    name = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    nodes = events.select(graph, name.alias("node"), label.alias("label"), F.col("p").cast("int").alias("ord"))
    kind = F.col("event_type")
    steps = F.array(
        F.when(~ends, F.lit(1)),
        F.when((F.col("p") % 10 == 3) & (F.col("p") + 4 < size) & (F.col("event_id") + 4 <= last), F.lit(4)),
        F.when((kind == "error") & (F.col("p") % 10 > 0), -(F.col("p") % 10)),
        F.when((kind == "refund") & (F.col("p") % 100 > 0), -(F.col("p") % 100)),
    )
    ways = events.select(graph, name.alias("src"), "event_id", F.explode(F.array_compact(steps)).alias("step"))
    target = F.concat(F.lit("e"), (F.col("event_id") + F.col("step")).cast("string"))
    return nodes, ways.select("graph_id", "src", target.alias("dst"))


def program_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session nodes with two more methods per graph; one of them is never called."""
    nodes = session_nodes(spark, sf_dir)
    graphs = nodes.where("node = 'start'").select("graph_id")
    more = [
        graphs.select(
            "graph_id",
            F.lit(f"m_{name}").alias("node"),
            F.lit(f"{fixed.METHOD_START} {name}").alias("label"),
            F.lit(1_000_001 + i).alias("ord"),
        )
        for i, name in enumerate(("click", "refund"))
    ]
    return union_all([nodes, *more])


def session_starts(nodes: DataFrame) -> DataFrame:
    """``(graph_id, node)`` of the method starts."""
    return nodes.where(F.col("label").startswith(fixed.METHOD_START)).select("graph_id", "node")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, text)`` of all documents and pages."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), "text"
    )
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("file"),
        F.col("html").alias("text"),
    )
    return docs.unionByName(pages)
