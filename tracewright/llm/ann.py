"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard, as flat neighbour arrays.

Rows are dealt evenly over shards by a hash. A shard's graph is built by inserting its distinct vectors
one after the other; the candidates of an insertion are the nearest of those inserted before, found for
a block of vectors at once by a matrix product. Graphs are built and searched in single precision on vectors that are
moved to their shard's mean and scaled to its spread. Each shard is searched for blocks of queries, and the shards'
results are merged by exact distances. Vectors of different lengths are in different shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import attach
from ..session import settle

#: Vectors of one graph, about; queries that one task searches with.
SHARD_ROWS, QUERY_ROWS = 8192, 1024
#: Links of a node on upper levels (twice as many on the lowest), candidates of an insertion, breadth of a search.
LINKS, BREADTH, SEARCH = 16, 64, 96


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, v, dim) of vectors that take part, as arrays of doubles: not null or zero, all components finite."""
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


class Frame:
    """Where a shard's vectors lie: its mean and spread, found without overflow."""

    def __init__(self, x: np.ndarray):
        self.unit = float(np.abs(x).max()) if x.size else 1.0
        y = x / self.unit
        self.mean = y.mean(axis=0)
        self.spread = float(np.abs(y - self.mean).max()) or 1.0

    def inside(self, x: np.ndarray) -> np.ndarray:
        """Single precision, and far outside vectors no farther than it can square."""
        with np.errstate(over="ignore"):
            return np.clip((x / self.unit - self.mean) / self.spread, -1e15, 1e15).astype(np.float32)


def distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; where squares would overflow or vanish, of scaled differences."""
    with np.errstate(over="ignore", under="ignore"):
        apart = x - v
        d = np.sqrt((apart**2).sum(axis=1))
        odd = np.flatnonzero(~np.isfinite(d) | (d < 1e-140))
        for k in odd.tolist():
            most = np.abs(apart[k]).max()
            if 0 < most < np.inf:
                d[k] = most * np.sqrt(((apart[k] / most) ** 2).sum())
    return d


def _chosen(order: np.ndarray, away: np.ndarray, x: np.ndarray, links: int) -> list[int]:
    """Of candidates, nearest first, those that are nearer to the node than to any one chosen before; then the nearest others."""
    among = x[order]
    square = (among * among).sum(axis=1)
    between = square[:, None] + square[None, :] - 2 * (among @ among.T)
    kept, nearest = [], np.full(len(order), np.inf)
    for k in range(len(order)):
        if len(kept) == links:
            break
        if away[k] < nearest[k]:
            kept.append(k)
            np.minimum(nearest, between[k], out=nearest)
    taken = set(kept)
    kept += [k for k in range(len(order)) if k not in taken][: max(0, links // 2 - len(kept))]
    return kept


def build(x: np.ndarray, links: int = LINKS, breadth: int = BREADTH, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the lowest on: node numbers in ascending order, and an array of each node's neighbours, filled up with -1.

    Vectors are inserted in order, and the first one of the highest level is where a search starts. A node is on
    level k with probability ``links`` ** -k.
    """
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(links)).astype(int)
    out = []
    for k in range(int(level.max()) + 1 if len(x) else 0):
        nodes = np.flatnonzero(level >= k)
        out.append((nodes, _level(x[nodes], 2 * links if k == 0 else links, links, breadth, nodes)))
    return out


def _level(x: np.ndarray, most: int, links: int, breadth: int, nodes: np.ndarray) -> np.ndarray:
    n = len(x)
    near: list[list[int]] = [[] for _ in range(n)]
    square = (x * x).sum(axis=1)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        away = square[lo:hi, None] + square[None, :hi] - 2 * (x[lo:hi] @ x[:hi].T)
        for i in range(max(lo, 1), hi):
            before = away[i - lo, :i]
            order = np.argpartition(before, breadth)[:breadth] if i > breadth else np.arange(i)
            order = order[np.argsort(before[order], kind="stable")]
            for k in _chosen(order, before[order], x, links):
                near[i].append(int(order[k]))
                near[int(order[k])].append(i)
    table = np.full((n, most), -1, np.int32)
    for i, found in enumerate(near):
        if len(found) > most:
            found = np.array(found)
            away = ((x[found] - x[i]) ** 2).sum(axis=1)
            order = found[np.argsort(away, kind="stable")]
            kept = _chosen(order, np.sort(away, kind="stable"), x, most)
            # the link to the first one chosen at insertion keeps the level in one piece
            found = list(dict.fromkeys([near[i][0], *order[kept].tolist()]))[:most]
        table[i, : len(found)] = nodes[np.array(found, int)] if len(found) else []
    return table


def search(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], query: np.ndarray, breadth: int = SEARCH) -> np.ndarray:
    """Numbers of about ``breadth`` nodes near ``query``, nearest first."""
    if not len(x):
        return np.zeros(0, int)

    def away(at):
        d = x[at] - query
        return np.einsum("ij,ij->i", d, d)

    at = int(levels[-1][0][0])
    best = float(away([at])[0])
    for nodes, table in levels[:0:-1]:
        while True:
            beside = table[np.searchsorted(nodes, at)]
            beside = beside[beside >= 0]
            if not len(beside):
                break
            d = away(beside)
            k = int(d.argmin())
            if d[k] >= best:
                break
            at, best = int(beside[k]), float(d[k])
    table = levels[0][1]
    seen = np.zeros(len(x), bool)
    seen[at] = True
    ahead, found = [(best, at)], [(-best, at)]
    while ahead:
        d, node = heapq.heappop(ahead)
        if d > -found[0][0] and len(found) >= breadth:
            break
        beside = table[node]
        beside = beside[beside >= 0]
        beside = beside[~seen[beside]]
        if not len(beside):
            continue
        seen[beside] = True
        ds = away(beside)
        if len(found) >= breadth:
            some = ds < -found[0][0]
            beside, ds = beside[some], ds[some]
        for d, b in zip(ds.tolist(), beside.tolist()):
            if len(found) < breadth:
                heapq.heappush(found, (-d, b))
            elif d < -found[0][0]:
                heapq.heapreplace(found, (-d, b))
            else:
                continue
            heapq.heappush(ahead, (d, b))
    return np.array([b for _, b in sorted((-d, b) for d, b in found)], int)


INDEX = "dim int, shard int, x binary, first array<int>, ids array<bigint>, levels array<struct<nodes:binary,links:binary>>"


def _shards(rows: DataFrame, shard_rows: int) -> DataFrame:
    """(dim, shards): how many shards the vectors of each length are dealt to."""
    return rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))


def index(rows: DataFrame, keep: int, shard_rows: int = SHARD_ROWS, links: int = LINKS, breadth: int = BREADTH) -> DataFrame:
    """A row per shard of a length: its distinct vectors, the ids of each (the smallest ``keep``), and its graph. Every row is indexed."""
    dealt = attach(rows, _shards(rows, shard_rows), ["dim"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).drop("shards")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        all_x = np.stack(pdf["v"].to_numpy())
        x, which = np.unique(all_x, axis=0, return_inverse=True)
        mixed = np.random.default_rng(1).permutation(len(x))
        place = np.empty(len(x), int)
        place[mixed] = np.arange(len(x))
        x, which = x[mixed], place[which.reshape(-1)]
        ids: list[list[int]] = [[] for _ in range(len(x))]
        for k, vec_id in zip(which.tolist(), pdf["vec_id"].tolist()):
            if len(ids[k]) < keep:
                ids[k].append(vec_id)
        first = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        levels = [
            {"nodes": a.astype(np.int32).tobytes(), "links": b.tobytes()} for a, b in build(Frame(x).inside(x), links, breadth)
        ]
        row = [x.shape[1], int(pdf["shard"].iloc[0]), x.tobytes(), first.tolist(), [i for part in ids for i in part], levels]
        return pd.DataFrame([row], columns=["dim", "shard", "x", "first", "ids", "levels"])

    return dealt.groupBy("dim", "shard").applyInPandas(task, INDEX)


def neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    column: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    breadth: int = SEARCH,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` nearest rows of ``vectors`` found, itself left out.

    Nearness is Euclidean distance in double precision on the vectors themselves, ties go to the smaller id. Null and zero vectors
    and those with a null or non-finite component take no part. There is no distance between vectors of different lengths: a
    query meets those of its own. Equal vectors are one node of a graph and all found with it. Rows that repeat an id count
    once each among ``vectors``; of such queries the least vector is asked for, by components.
    """
    rows = settle(usable(vectors, id_column, column))
    built = settle(index(rows, k + 1, shard_rows))
    asked = settle(usable(queries, id_column, column).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    blocks = max(1, -(-asked.count() // query_rows))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    # each shard meets each block of queries once: a stated set of queries against all rows
    left = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = attach(asked.withColumn("block", block), _shards(rows, shard_rows), ["dim"])
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    right = right.select("dim", "shard", "block", F.col("vec_id").alias("query_id"), "v")

    def task(key: tuple, own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(own) and len(ask):
            row = own.iloc[0]
            x = np.frombuffer(row["x"], np.float64).reshape(-1, int(row["dim"]))
            frame = Frame(x)
            small = frame.inside(x)
            levels = []
            for part in row["levels"]:
                nodes = np.frombuffer(part["nodes"], np.int32)
                levels.append((nodes, np.frombuffer(part["links"], np.int32).reshape(len(nodes), -1)))
            first, ids = np.asarray(row["first"]), np.asarray(row["ids"])
            for query_id, v in zip(ask["query_id"].tolist(), ask["v"]):
                v = np.asarray(v, float)
                found = search(small, levels, frame.inside(v), max(breadth, k + 1))
                d = distances(x[found], v)
                near = [(s, int(i)) for s, f in zip(d.tolist(), found.tolist()) for i in ids[first[f] : first[f + 1]] if i != query_id]
                out += [(query_id, i, s) for s, i in sorted(near)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    met = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block"))
    found = met.applyInPandas(task, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
