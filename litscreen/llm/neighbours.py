"""Approximate nearest neighbours by cosine: a forest of random-projection trees and a shared priority queue."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from litscreen.functions.scale import stage
from litscreen.llm.common import ship_package

TREES = 8
LEAF = 64  # distinct vectors that a leaf holds, about
LEAVES, SHARE = 200, 0.1  # leaves looked at per query, over all trees: so many, and this part of all, at least
SAMPLE = 20_000  # vectors that place the splits
SHARD, ASKED = 8_192, 2_048  # points and queries, about, that one task takes


@dataclass
class Forest:
    """Splits of all trees. The nodes of a level share their direction; each has a threshold of its own."""

    directions: np.ndarray  # tree x level x component
    thresholds: list[np.ndarray]  # per level: tree x node

    def project(self, x: np.ndarray) -> np.ndarray:
        """vector x tree x level"""
        return np.einsum("nd,tld->ntl", x, self.directions)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        p = self.project(x)
        node = np.zeros(p.shape[:2], np.int64)
        tree = np.arange(p.shape[1])
        for level, t in enumerate(self.thresholds):
            node = 2 * node + (p[:, :, level] > t[tree, node])
        return node

    def search(self, x: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The ``most`` leaves, over all trees, whose boxes one has to leave the least far to reach.

        One queue holds the branches not taken of all trees, ordered by the squared distances to the splits passed on the
        wrong side, so a tree that cuts close to the query is looked at more often than one that doesn't.
        """
        p = self.project(x[None])[0]
        depth = len(self.thresholds)
        queue = [(0.0, tree, 0, 0) for tree in range(p.shape[0])]
        found = []
        while queue and len(found) < most:
            cost, tree, level, node = heappop(queue)
            while level < depth:
                gap = p[tree, level] - self.thresholds[level][tree, node]
                near = 2 * node + (gap > 0)
                heappush(queue, (cost + gap * gap, tree, level + 1, 2 * node + (gap <= 0)))
                level, node = level + 1, near
            found.append((tree, int(node)))
        return found


def grow(sample: np.ndarray, trees: int, depth: int, seed: int = 5) -> Forest:
    """Random directions, and the median of each node's part of the sample as its threshold."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    directions = rng.standard_normal((trees, depth, d))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    p = np.einsum("nd,tld->ntl", sample, directions)
    node = np.zeros((len(sample), trees), np.int64)
    thresholds = []
    for level in range(depth):
        cut = np.zeros((trees, 1 << level))
        for tree in range(trees):
            order = np.argsort(node[:, tree], kind="stable")
            at = np.searchsorted(node[order, tree], np.arange((1 << level) + 1))
            for k in range(1 << level):
                part = order[at[k] : at[k + 1]]
                if len(part):
                    cut[tree, k] = np.median(p[part, tree, level])
        thresholds.append(cut)
        node = 2 * node + (p[:, :, level] > cut[np.arange(trees), node])
    return Forest(directions, thresholds)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and no component null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, trees: int = TREES, leaf: int = LEAF, leaves: int = LEAVES,
    share: float = SHARE, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows where ``queries`` holds, the k nearest others found, nearest first.

    ``queries`` is a condition on ``vec_id``. Score is the cosine in double precision; ties go to the smaller id. Vectors
    that are null, zero, or hold null or non-finite components, and rows without an id, take no part; only vectors of the
    same number of components are compared. Repeated rows count once. An id of several vectors asks once for each and is
    not its own neighbour. Fewer candidates give fewer rows; an empty table gives none. Extra columns play no part.

    Equal vectors are one point that carries its k + 1 smallest ids, which is all that ties can ask for, so a vector that
    a third of all rows hold is one point. Splits come from at most ``sample`` points, those with the smallest hash, but
    every point is put into a leaf of every tree. Points are dealt out to shards; a shard lists its points by leaf, unites
    the lists of the leaves that a query chose, compares those candidates exactly and returns the k + 1 best, so neither
    a vector is copied per tree nor a candidate list leaves its task. ``leaves`` and ``share`` set the part searched.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    points = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = stage(points.withColumn("point", F.concat_ws(":", F.get("ids", F.lit(0)), F.xxhash64("v"))), "points")
    asked = rows.filter(queries).distinct().select(F.col("vec_id").alias("query_id"), "v")
    out = None
    for size in [r["n"] for r in points.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]:
        found = _search(points.filter(F.size("v") == size), asked.filter(F.size("v") == size), k, trees, leaf, leaves, share, sample)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _search(
    points: DataFrame, asked: DataFrame, k: int, trees: int, leaf: int, leaves: int, share: float, sample: int
) -> DataFrame:
    n, m = points.count(), asked.count()
    some = points.select("v").orderBy(F.xxhash64("v"), "point").limit(sample).collect()
    base = _unit(np.array([r["v"] for r in some]))
    depth = min(max(0, int(np.ceil(np.log2(max(1.0, n / leaf))))), max(0, int(np.log2(max(1, len(base) // 4)))))
    forest = grow(base, trees, depth)
    most = max(leaves, int(share * trees * (1 << depth)))
    sent = points.sparkSession.sparkContext.broadcast(forest)
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // ASKED))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [[t << 32 | node for t, node in own.search(x, most)] for x in _unit(_matrix(part.column("v")))]
                columns = [part.column("query_id"), part.column("v"), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "v", "chosen"])

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        q, p = _matrix(one.column("v")), _matrix(two.column("v"))
        out: list[tuple] = []
        if len(q) and len(p):
            ids, asking = one.column("query_id").to_pylist(), one.column("asking").to_pylist()
            lists = two.column("ids").to_pylist()
            least, norms = np.array([x[0] for x in lists]), np.linalg.norm(p, axis=1)
            placed = (sent.value.leaves(_unit(p)) | np.arange(trees)[None] << 32).ravel()
            order = np.argsort(placed, kind="stable")
            placed, owner = placed[order], order // trees
            for i, chosen in enumerate(one.column("chosen").to_pylist()):
                low, high = np.searchsorted(placed, chosen), np.searchsorted(placed, chosen, "right")
                here = np.zeros(len(p), bool)
                for x, y in zip(low.tolist(), high.tolist(), strict=True):
                    here[owner[x:y]] = True
                near = np.flatnonzero(here)
                cosine = p[near] @ q[i] / norms[near] / np.linalg.norm(q[i])
                if len(near) > 4 * k:  # all that can be among the first, ties included
                    at = cosine >= np.partition(cosine, -(k + 1))[-(k + 1)]
                    near, cosine = near[at], cosine[at]
                for j in np.lexsort((least[near], -cosine))[: k + 1]:
                    out.append((ids[i], asking[i], float(cosine[j]), lists[near[j]]))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
        names = ["query_id", "asking", "score", "ids"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    chosen = asked.mapInArrow(probe, "query_id long, v array<double>, chosen array<long>")
    chosen = chosen.withColumn("asking", F.xxhash64("v")).withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)))
    chosen = chosen.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    laid = points.select("v", "ids", F.pmod(F.xxhash64("point"), F.lit(shards)).alias("shard"))
    laid = laid.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    near = (
        chosen.groupBy("shard", "block").cogroup(laid.groupBy("shard", "block"))
        .applyInArrow(compare, "query_id long, asking long, score double, ids array<long>")
    )
    each = near.select("query_id", "asking", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    each = each.groupBy("query_id", "asking", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "asking").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.list_(pa.float64()))
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1) if len(array) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if x.size else x.reshape(0, 1)


def brute_force(rows: list[tuple], asked, k: int = 5) -> dict:
    """All cosines: for tests. ``{query_id: [(vec_id, score), ...]}``."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in good])
    matrix = np.stack([v for _, v in good])
    norms = np.linalg.norm(matrix, axis=1)
    out = {}
    for i, v in good:
        if asked(i):
            cosine = matrix @ v / norms / np.linalg.norm(v)
            cosine[ids == i] = -np.inf
            best = np.lexsort((ids, -cosine))[:k]
            out[i] = [(int(ids[j]), float(cosine[j])) for j in best]
    return out
