"""Random forests by the rules of Spark's ML library, grown from counts of rows that no split can tell apart.

The library splits a feature at a few thresholds only (``maxBins``), so rows that lie between the same ones are one
cell. A table of cells has the columns ``y``, how often each tree draws the cell's rows of each class, tree by tree, and
``features``, the number of thresholds below each feature. The draws of n rows add up to one draw for n of them: Poisson
or binomial as those of single rows are, so a cell is drawn once and nothing is left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle_measured
from .joins import attach

#: As in the library: classes a label may name, and sampled rows that say where features may be split.
MOST_CLASSES = 100
SAMPLED = 10_000
#: Thresholds, of all features together, up to which rows of a cell are counted together. More of them leave hardly two
#: rows in a cell: then each row is one.
MOST_POINTS = 400
ROWS_A_PART = 500_000
HISTOGRAM_MB = 64


@dataclass
class Facts:
    """What is known of a variable's rows before its trees grow: how many, their classes, each feature's thresholds."""

    rows: int
    classes: int
    points: list[list[float]]


@dataclass
class Tree:
    """Nodes by number, 0 being the root; ``feature`` is -1 at leaves, ``at`` the last bin that goes left."""

    feature: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    stats: list[np.ndarray] = field(default_factory=list)

    def leaf(self, stats: np.ndarray) -> int:
        for values, value in zip((self.feature, self.at, self.left, self.right, self.gain), (-1, -1, -1, -1, 0.0)):
            values.append(value)
        self.stats.append(stats)
        return len(self.stats) - 1

    def split(self, node: int, feature: int, at: int, gain: float, left: np.ndarray, right: np.ndarray) -> list[int]:
        self.feature[node], self.at[node], self.gain[node] = feature, at, gain
        self.left[node], self.right[node] = self.leaf(left), self.leaf(right)
        return [self.left[node], self.right[node]]


def split_points(values: list[float], counts: list[int], bins: int) -> list[float]:
    """Thresholds between sorted values: all if there are fewer than ``bins``, else where equal shares of the counts end."""
    middles = [(a + b) / 2.0 for a, b in zip(values, values[1:])]
    if len(middles) < bins:
        return sorted(set(middles))
    stride = sum(counts) / bins
    found, target, upto = [], stride, counts[0]
    for middle, count in zip(middles, counts[1:]):
        before, upto = upto, upto + count
        if abs(before - target) < abs(upto - target):
            found.append(middle)
            target += stride
    return sorted(set(found))


def facts_of(labels: DataFrame, variables: list[str], forest, sampled: Callable[[float], DataFrame]) -> dict[str, Facts]:
    """Facts of each named variable, from ``(treatment_var, y)`` of all rows; labels the library refuses are an error.

    As in the library, the thresholds of a feature are those of a sample of ``max(maxBins ** 2, 10000)`` rows; which of
    them split a node, all rows say. ``sampled`` gives ``feature_rows`` of a share of the rows.
    """
    max_bins = forest.getMaxBins()
    wanted = max(max_bins**2, SAMPLED)
    named = F.col("treatment_var").isin(*variables)
    facts = settle_measured(
        labels.where(named).groupBy("treatment_var").agg(
            F.count(F.lit(1)).alias("n"),
            F.least(F.lit(1.0), wanted / F.count(F.lit(1))).alias("share"),
            F.count("y").alias("labelled"),
            F.min("y").alias("low"),
            F.max("y").alias("top"),
            F.max(F.abs(F.col("y") - F.rint("y"))).alias("rest"),
        )
    )
    known = {r.treatment_var: r for r in facts.table.collect()}
    for variable in variables:
        if variable not in known:
            raise ValueError(f"no rows of {variable!r} to train on")
        r = known[variable]
        if r.labelled < r.n or not (0 <= r.low and r.top < MOST_CLASSES and r.rest == 0):
            raise ValueError(f"outcomes of {variable!r} are not all whole numbers from 0 to {MOST_CLASSES - 1}")

    def points(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("value")
        found = split_points(part["value"].tolist(), part["n"].tolist(), min(max_bins, int(part["rows"].iloc[0])))
        return pd.DataFrame({"treatment_var": part["treatment_var"].iloc[:1], "no": part["no"].iloc[:1], "points": [found]})

    shares = facts.table.select("treatment_var", "share", F.col("n").alias("rows"))
    most = max((r.share for r in known.values()), default=1.0)
    sample = sampled(most)
    d = len(sample.columns) - 2
    drawn = attach(sample, shares, ["treatment_var"], size=facts.bytes)
    drawn = drawn.where(F.rand(forest.getSeed() + 1) < F.col("share") / most)
    x = F.array(*[F.col(f"x{i}") for i in range(d)])
    values = drawn.select("treatment_var", "rows", F.posexplode(x).alias("no", "value"))
    # values that are not finite are an error where all rows are read
    values = values.where(F.abs("value") < float("inf"))
    counts = values.groupBy("treatment_var", "rows", "no", "value").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("treatment_var", "no").applyInPandas(points, "treatment_var string, no int, points array<double>")
    result = {v: Facts(known[v].n, int(known[v].top) + 1, [[] for _ in range(d)]) for v in variables}
    for row in found.collect():
        result[row.treatment_var].points[row.no] = list(row.points)
    return result


def _below(name: str, points: list[float], first: int = 0) -> str:
    """SQL for how many of the sorted points are below a column, by halving; all of them are below NaN."""
    if not points:
        return str(first)
    mid = len(points) // 2
    return f"IF({name} <= double('{float(points[mid])!r}'), {_below(name, points[:mid], first)}, {_below(name, points[mid + 1:], first + mid + 1)})"


def placed(rows: DataFrame, points: list[list[float]]) -> DataFrame:
    """The rows with the number of thresholds below each feature in place of it."""
    return rows.withColumns({f"x{i}": F.expr(_below(f"x{i}", p)).cast("int") for i, p in enumerate(points)})


def few_enough(points: list[list[float]]) -> bool:
    """Whether rows between the same thresholds are counted together."""
    return sum(map(len, points)) <= MOST_POINTS


def _list_column(values: np.ndarray) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, values.reshape(-1))


def bagged_cells(rows: DataFrame, facts: Facts, forest) -> DataFrame:
    """``(y, features)`` of one variable's rows: the cells with their draws.

    The draws follow the seed and the cell's place among the sorted cells of its partition, so a task that runs again
    draws alike. A feature that is not finite is an error, as in the library.
    """
    trees, rate, bootstrap = forest.getNumTrees(), forest.getSubsamplingRate(), forest.getBootstrap()
    seed, classes, points = forest.getSeed() % (1 << 64), facts.classes, facts.points
    names, together = [f"x{i}" for i in range(len(points))], few_enough(points)
    # NaN is above all numbers
    finite = F.greatest(F.lit(0.0), *[F.abs(n) for n in names]) < float("inf")
    label = F.when(finite, F.col("y")).otherwise(F.raise_error(F.lit("features of a forest must not be NaN or infinite")))
    rows = rows.withColumn("y", label)
    own = [(F.col("y") == c).cast("long") for c in range(classes)]
    if together:
        counted = placed(rows, points).groupBy(*names).agg(*[F.sum(c).alias(f"n{i}") for i, c in enumerate(own)])
        parts = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + facts.rows // ROWS_A_PART)
        cells = counted.repartition(parts, *names).sortWithinPartitions(*names)
    else:
        cells = rows.select(*names, *[c.alias(f"n{i}") for i, c in enumerate(own)])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            bins = np.stack(x if together else [np.searchsorted(p, v) for p, v in zip(points, x)], axis=1)
            n = np.stack([batch.column(f"n{c}").to_numpy(zero_copy_only=False) for c in range(classes)], axis=1)
            every = np.broadcast_to(n[:, None, :], (len(n), trees, classes))
            if bootstrap:
                drawn = rng.poisson(every * rate)
            else:
                drawn = rng.binomial(every, rate) if rate < 1 else every
            drawn = np.ascontiguousarray(drawn, dtype=np.int64).reshape(len(n), -1)
            yield pa.RecordBatch.from_arrays([_list_column(drawn), _list_column(bins.astype(np.int32))], ["y", "features"])

    return cells.mapInArrow(draw, "y array<bigint>, features array<int>")


def features_a_node(strategy: str, features: int, trees: int) -> int:
    """How many features a node may choose from, by the library's ``featureSubsetStrategy``."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    named = {
        "all": features,
        "sqrt": int(np.ceil(np.sqrt(features))),
        "log2": max(1, int(np.ceil(np.log2(features)))),
        "onethird": int(np.ceil(features / 3)),
    }
    if strategy in named:
        return named[strategy]
    if re.fullmatch(r"\d+", strategy) and int(strategy):
        return min(int(strategy), features)
    if 0 < float(strategy) <= 1:
        return int(np.ceil(float(strategy) * features))
    raise ValueError(f"unknown featureSubsetStrategy {strategy!r}")


def impurity(stats: np.ndarray, kind: str) -> np.ndarray:
    """Gini impurity or entropy of class counts, over the last axis; 0 of no rows."""
    share = stats / np.maximum(stats.sum(axis=-1, keepdims=True), 1)
    if kind == "gini":
        return np.where(stats.any(axis=-1), 1 - (share**2).sum(axis=-1), 0.0)
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=-1)


def best_split(sums: np.ndarray, splits: int, kind: str, least_rows: float, least_gain: float) -> tuple:
    """``(gain, at, left, right)`` of the best threshold by class counts per bin; a gain of -inf if none is allowed."""
    left = np.cumsum(sums, axis=0)[:splits]
    total = sums.sum(axis=0)
    right = total - left
    on_left, on_right = left.sum(axis=1), right.sum(axis=1)
    shares = on_left / max(total.sum(), 1), on_right / max(total.sum(), 1)
    gain = impurity(total, kind) - shares[0] * impurity(left, kind) - shares[1] * impurity(right, kind)
    allowed = (on_left >= least_rows) & (on_right >= least_rows) & (gain >= least_gain)
    gain = np.where(allowed, gain, -np.inf)
    if not allowed.any():
        return -np.inf, -1, total, np.zeros_like(total)
    at = int(np.argmax(gain))
    return float(gain[at]), at, left[at], right[at]


def _choices(cells: DataFrame, trees: list[Tree], nodes: list[tuple], facts: Facts, forest) -> DataFrame:
    """The best split of each of ``nodes``, which are ``(tree, node, features)``: one pass over the cells."""
    classes, bins = facts.classes, max(map(len, facts.points)) + 1
    splits = [len(p) for p in facts.points]
    kind, least_gain = forest.getImpurity(), forest.getMinInfoGain()
    least_rows = max(forest.getMinInstancesPerNode(), forest.getMinWeightFractionPerNode() * facts.rows)
    ways = [[np.array(v) for v in (t.feature, t.at, t.left, t.right)] for t in trees]
    # where each tree's nodes are in its histogram, and in the list
    slots, chosen, places = [], [], []
    for no, tree in enumerate(trees):
        mine = [(place, node, some) for place, (of, node, some) in enumerate(nodes) if of == no]
        slot = np.full(len(tree.feature), -1)
        slot[[node for _, node, _ in mine]] = np.arange(len(mine))
        slots.append(slot)
        chosen.append(np.array([some for _, _, some in mine]))
        places.append([place for place, _, _ in mine])
    width = len(nodes[0][2])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((classes, len(p) * width * bins)) for p in places]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            y = batch.column("y").flatten().to_numpy().reshape(n, len(ways), classes)
            x = batch.column("features").flatten().to_numpy().reshape(n, len(splits))
            for no, (feature, at, left, right) in enumerate(ways):
                rows = np.flatnonzero(y[:, no].any(axis=1))
                node = np.zeros(len(rows), dtype=int)
                while len(places[no]):
                    inner = np.flatnonzero(feature[node] >= 0)
                    if not len(inner):
                        break
                    here = node[inner]
                    goes_left = x[rows[inner], feature[here]] <= at[here]
                    node[inner] = np.where(goes_left, left[here], right[here])
                slot = slots[no][node]
                rows, slot = rows[slot >= 0], slot[slot >= 0]
                if not len(rows):
                    continue
                for j in range(width):
                    where = (slot * width + j) * bins + x[rows, chosen[no][slot, j]]
                    for c in range(classes):
                        sums[no][c] += np.bincount(where, weights=y[rows, no, c], minlength=sums[no].shape[1])
        for no, found in enumerate(sums):
            if not found.any():
                continue
            # a row for each node and feature
            lists = found.reshape(classes, -1, bins).transpose(1, 2, 0).reshape(-1, bins * classes)
            place = np.repeat(np.array(places[no], dtype=np.int32), width)
            j = np.tile(np.arange(width, dtype=np.int32), len(places[no]))
            some = lists.any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[some]), pa.array(j[some]), _list_column(lists[some])], ["place", "j", "sums"]
            )

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        place, j = int(part["place"].iloc[0]), int(part["j"].iloc[0])
        feature = nodes[place][2][j]
        sums = np.sum(part["sums"].tolist(), axis=0).reshape(bins, classes)
        gain, at, left, right = best_split(sums, splits[feature], kind, least_rows, least_gain)
        # of equal gains that of the feature chosen first
        return pd.DataFrame([(place, gain, -j, feature, at, left.tolist(), right.tolist())], columns=columns)

    columns = ["place", "gain", "rank", "feature", "at", "left", "right"]
    found = cells.mapInArrow(count, "place int, j int, sums array<double>").groupBy("place", "j").applyInPandas(
        choose, "place int, gain double, rank int, feature int, at int, left array<double>, right array<double>"
    )
    return found.groupBy("place").agg(F.max(F.struct(*columns[1:])).alias("best")).select("place", "best.*")


def grow(cells: DataFrame, facts: Facts, forest) -> list[Tree]:
    """The trees, level by level and all at once; the driver holds the nodes, and one split for each."""
    rng = np.random.default_rng(forest.getSeed() % (1 << 64))
    features, classes, kind = len(facts.points), facts.classes, forest.getImpurity()
    trees = [Tree() for _ in range(forest.getNumTrees())]
    width = features_a_node(forest.getFeatureSubsetStrategy(), features, len(trees))
    bins = max(map(len, facts.points)) + 1
    at_once = max(1, min(forest.getMaxMemoryInMB(), HISTOGRAM_MB) * 2**20 // (8 * width * bins * classes))
    level = [(no, tree.leaf(np.zeros(classes))) for no, tree in enumerate(trees)]
    for depth in range(max(1, forest.getMaxDepth())):
        below = []
        for start in range(0, len(level), at_once):
            nodes = [
                (no, node, list(range(features)) if width == features else rng.choice(features, width, replace=False).tolist())
                for no, node in level[start : start + at_once]
            ]
            for row in _choices(cells, trees, nodes, facts, forest).collect():
                no, node, _ = nodes[row.place]
                left, right = np.array(row.left), np.array(row.right)
                trees[no].stats[node] = left + right
                if row.gain <= 0 or depth == forest.getMaxDepth():
                    continue
                made = trees[no].split(node, row.feature, row.at, row.gain, left, right)
                below += [(no, child) for child in made if impurity(trees[no].stats[child], kind) > 0]
        level = sorted(below)
        if not level:
            break
    return trees


def as_model(trees: list[Tree], facts: Facts, forest, spark):
    """The trees as the library's model, with siblings that predict the same class made one leaf, as it does."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml, impurities = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity
    kind = forest.getImpurity()
    calculator = impurities.GiniCalculator if kind == "gini" else impurities.EntropyCalculator

    def node_of(tree: Tree, at: int) -> tuple:
        """The node, and the class it predicts if it is a leaf."""
        stats = tree.stats[at]
        predicted, unlike = int(np.argmax(stats)), float(impurity(stats, kind))
        counts = gateway.new_array(jvm.double, len(stats))
        for c, n in enumerate(stats):
            counts[c] = float(n)
        held = calculator(counts, int(stats.sum()))
        if tree.feature[at] >= 0:
            (left, on_left), (right, on_right) = node_of(tree, tree.left[at]), node_of(tree, tree.right[at])
            if on_left is None or on_left != on_right:
                feature = tree.feature[at]
                split = ml.tree.ContinuousSplit(feature, float(facts.points[feature][tree.at[at]]))
                return ml.tree.InternalNode(float(predicted), unlike, float(tree.gain[at]), left, right, split, held), None
        return ml.tree.LeafNode(float(predicted), unlike, held), predicted

    made = gateway.new_array(ml.classification.DecisionTreeClassificationModel, len(trees))
    for no, tree in enumerate(trees):
        made[no] = ml.classification.DecisionTreeClassificationModel(node_of(tree, 0)[0], len(facts.points), facts.classes)
    built = ml.classification.RandomForestClassificationModel(forest.uid, made, len(facts.points), facts.classes)
    return forest._copyValues(forest._create_model(built))


def points_of(model) -> list[list[float]] | None:
    """The thresholds each feature is split at in a forest of the library, or None if it also splits by category."""
    text = model.toDebugString
    if re.search(r"\(feature \d+ (not )?in ", text):
        return None
    points = [set() for _ in range(model.numFeatures)]
    for feature, point in re.findall(r"If \(feature (\d+) <= (\S+)\)", text):
        points[int(feature)].add(float(point))
    return [sorted(p) for p in points]


def counted(rows: DataFrame, points: list[list[float]] | None) -> tuple[DataFrame, list[Column]]:
    """Rows between the same thresholds as one, and features for it: ``n`` says how many rows it stands for.

    Thresholds are for the first features; no others are read.
    """
    if points is None or not few_enough(points):
        return rows.withColumn("n", F.lit(1)), [F.col(c) for c in rows.columns if re.fullmatch(r"x\d+", c)]
    used = [f"x{i}" for i, p in enumerate(points) if p]
    cells = placed(rows, points).groupBy("treatment_var", *used).agg(F.count(F.lit(1)).alias("n"))
    # any value does that lies between the same thresholds: the one above, or what is above all
    between = [
        F.get(F.array(*[F.lit(v) for v in (*p, float("inf"))]), F.col(f"x{i}")) if p else F.lit(0.0)
        for i, p in enumerate(points)
    ]
    return cells, between
