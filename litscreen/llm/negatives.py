"""Hard negatives: for each anchor and positive, the best scored rows of other labels within a window below the positive.

The windows of an anchor overlap. The upper limits of its positives cut the scores into disjoint slots; every task keeps the
first few rows of each slot, and a window is answered from the slots at and below its upper limit, merged downwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litscreen.functions.scale import stage
from litscreen.llm.common import ship_package

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
LABELS = 10
PART_BYTES = 16 << 20  # of anchors that are sent to the tasks at a time
ROWS_AT_ONCE = 512
CELLS = 1 << 21  # of a matrix of scores
EXACT = float(1 << 53)


def prepared(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, x`` of the rows that take part, with the changed labels."""
    label = F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % LABELS).otherwise(F.col(label_col)).cast("long")
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows


def _whole(vectors: list[list[float]], width: int) -> np.ndarray:
    """floor(256 x) as doubles, which hold it exactly."""
    return np.floor(256.0 * np.array(vectors, np.float64).reshape(len(vectors), width))


def _products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers: by doubles where every partial sum is exact, else by Python's integers."""
    top = np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * max(1, rows.shape[1])
    if top < EXACT:
        return (rows @ anchors.T).astype(np.int64)
    whole = [[[int(v) for v in r] for r in m] for m in (rows, anchors)]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(high, max(low, sum(a * b for a, b in zip(x, y, strict=True)))) for y in whole[1]] for x in whole[0]], np.int64).reshape(len(rows), len(anchors))


class Best:
    """The first ``k`` rows of each group by score, ties by smaller id; an equal (score, id) counts once."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(groups, np.iinfo(np.int64).min)  # what a score must reach to come in

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, group))  # ~x is -x - 1, so it orders downwards without passing 64 bits
        group, score, ids = group[order], score[order], ids[order]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        group, score, ids = group[new], score[new], ids[new]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        nth = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
        full = nth == self.k - 1
        self.least[group[full]] = score[full]
        self.group, self.score, self.id = (x[nth < self.k] for x in (group, score, ids))


class Anchors:
    """A part of the anchors, by length of their vectors."""

    def __init__(self, rows: list[tuple[int, int, list[float]]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.int64)
        self.widths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(r[2]) for r in rows])
        for width in set(lengths.tolist()):
            where = np.flatnonzero(lengths == width)
            self.widths[width] = (where, _whole([rows[i][2] for i in where], width))

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """``(anchors, row ids, row labels, scores)`` for rows and anchors of equal length, a bounded matrix at a time."""
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy() for c in ("id", "label"))
            vectors = batch.column("x")
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for width, (where, matrix) in self.widths.items():
                own = np.flatnonzero(lengths == width)
                step = max(1, min(ROWS_AT_ONCE, CELLS // max(1, len(where))))
                for i in range(0, len(own), step):
                    rows = own[i : i + step]
                    x = np.floor(256.0 * flat[starts[rows][:, None] + np.arange(width)]) if width else np.zeros((len(rows), 0))
                    yield where, ids[rows], labels[rows], _products(x, matrix)


ROWS = "anchor int, slot int, id long, score long"


def _rows(groups: np.ndarray, per: int, best: Best) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(groups), 50_000):
        g = groups[i : i + 50_000]
        columns = [pa.array((g // per).astype(np.int32)), pa.array((g % per).astype(np.int32)), pa.array(best.id[i : i + 50_000]), pa.array(best.score[i : i + 50_000])]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "id", "score"])


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and slot among what the tasks kept."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("id"))
    return rows.distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def _positives(rows: DataFrame, sent, k: int) -> DataFrame:
    """For each anchor, its first ``k`` other rows of the same label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = sent.value
        best = Best(len(anchors.ids), k)
        for where, ids, labels, scores in anchors.blocks(batches):
            fits = (labels[:, None] == anchors.labels[where]) & (ids[:, None] != anchors.ids[where]) & (scores >= best.least[where])
            i, j = np.nonzero(fits)
            best.add(where[j], scores[i, j], ids[i])
        yield from _rows(best.group, 1, best)

    return _first(rows.mapInArrow(run, ROWS), k)


def _slots(rows: DataFrame, sent, limits, k: int) -> DataFrame:
    """For each anchor and slot, the first ``k`` rows of other labels. Slot i holds scores from above limit i + 1 to limit i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = sent.value
        upper, lowest = limits.value  # by anchor: descending limits, filled up with the smallest number; and the lower end
        per = upper.shape[1]
        best = Best(upper.shape[0] * per, k)
        for where, ids, labels, scores in anchors.blocks(batches):
            other = (labels[:, None] != anchors.labels[where]) & (ids[:, None] != anchors.ids[where])
            i, j = np.nonzero(other & (scores <= upper[where, 0]) & (scores >= lowest[where]))
            a, s = where[j], scores[i, j]
            slot = (s[:, None] <= upper[a]).sum(axis=1) - 1
            group = a * per + slot
            enough = s >= best.least[group]
            best.add(group[enough], s[enough], ids[i[enough]])
        yield from _rows(best.group, per, best)

    return _first(rows.mapInArrow(run, ROWS), k)


def _limits(found: list, anchors: int, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper limits of each anchor's positives, different ones descending, and the smallest lower limit."""
    none = np.iinfo(np.int64).min
    upper, lowest = np.full((anchors, max(1, k)), none), np.full(anchors, np.iinfo(np.int64).max)
    tops: dict[int, set[int]] = {}
    for r in found:
        s = r["score"]
        if -(-low * s // 100) <= high * s // 100:
            tops.setdefault(r["anchor"], set()).add(high * s // 100)
            lowest[r["anchor"]] = min(lowest[r["anchor"]], -(-low * s // 100))
    for a, values in tops.items():
        upper[a, : len(values)] = sorted(values, reverse=True)
    return upper, lowest


def hard_negatives(
    table: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of floor(256 x), exact in 64 bits (beyond those they stop at the bounds). An anchor's positives are
    its first other rows of the same label; for each, the first rows of other labels whose score is ``low`` to ``high`` per cent
    of the positive's are returned, higher scores first, ties by smaller id. Where the id is divisible by 7 the label first becomes
    (label + 1) % 10.

    Rows without id or label, or without a vector of finite numbers, take no part. Vectors of other length than the anchor's
    aren't compared with it. Repeated rows count once; rows that share the anchor's id are never its partners; of rows that share
    an id and a score one counts, and equal anchors are one. An empty table gives no rows. Extra columns play no part.

    Anchors are dealt into parts of about ``part_bytes``, sent to the tasks one part at a time; the table is read twice for each
    and never shuffled. What a task sends on is a few rows for each anchor and slot.
    """
    spark = table.sparkSession
    ship_package(spark)
    chosen = table.filter(is_anchor)
    rows, anchors = (prepared(t, id_col, vector_col, label_col) for t in (table, chosen))
    anchors = anchors.distinct()
    size = anchors.agg(F.coalesce(F.sum(F.size("x") * 8 + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    out = None
    for part in range(parts):
        mine = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        held = sorted((r["id"], r["label"], r["x"]) for r in mine.collect())  # about part_bytes
        if not held and part:
            continue
        sent = spark.sparkContext.broadcast(Anchors(held))
        found = stage(_positives(rows, sent, positives), "positives")
        limits = spark.sparkContext.broadcast(_limits(found.select("anchor", "score").collect(), len(held), positives, low, high))
        names = spark.createDataFrame([(i, h[0]) for i, h in enumerate(held)], "anchor int, anchor_id long")
        kept = stage(_slots(rows, sent, limits, negatives), "slots")
        one = stage(_windows(found, kept, names, negatives, low, high), "negatives")
        sent.destroy()
        limits.destroy()
        out = one if out is None else out.unionByName(one)
    return out


def _windows(found: DataFrame, kept: DataFrame, names: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The slots of an anchor in descending order; a window is what of them begins at its upper limit, cut at its lower one."""
    # ~x orders scores downwards without passing 64 bits.
    slots = kept.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", F.bitwise_not("score").alias("down"), "id", "score"))).alias("s"))
    score = F.col("positive_score").cast("decimal(20,0)")
    rows = found.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(slots, "anchor").join(F.broadcast(names), "anchor")
    below = F.filter("s", lambda x: 100 * x["score"].cast("decimal(20,0)") <= high * score)
    inside = F.filter(F.slice(below, 1, k), lambda x: 100 * x["score"].cast("decimal(20,0)") >= low * score)
    listed = rows.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("pos", "x"))
    return listed.select(
        "anchor_id", "positive_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score")
    )


ORACLE = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM part a JOIN part b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS rank,
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) <= 3
"""


def brute_force(rows: list[tuple], anchor, positives: int = POSITIVES, negatives: int = NEGATIVES) -> list[tuple]:
    """All pairs: for tests. ``rows`` are (id, label, vector)."""
    import math

    fine = []
    for i, label, x in dict.fromkeys((i, label, None if x is None else tuple(x)) for i, label, x in rows):
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            fine.append((i, (label + 1) % LABELS if i % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    out = []
    for a, label, x in fine:
        if not anchor(a):
            continue
        scored = sorted({(-sum(p * q for p, q in zip(x, y, strict=True)), i, other == label) for i, other, y in fine if i != a and len(y) == len(x)})
        for s, p, _ in [t for t in scored if t[2]][:positives]:
            fits = [t for t in scored if not t[2] and LOW * -s <= 100 * -t[0] <= HIGH * -s][:negatives]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fits, 1)]
    return out
