"""Connected components of a large, sparse graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscreen.functions.scale import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the undirected ``edges`` (``a``, ``b``); the component is its smallest node.

    Each round hangs every node below its smallest neighbour, follows those pointers once more, and contracts the graph,
    so edges shrink by a factor each time; what a node hangs below is put together at the end. All steps are joins and
    partial aggregations: a node of very many edges is folded before it is shuffled, and on the wide side of a join it is
    a key that adaptive execution splits. Each round's pointers and edges are written to the shared folder, so a lost
    executor repeats one round at most. Loops and nulls are ignored; repeated edges count once; no edges give no rows.
    """
    left = stage(_ordered(edges.filter("a <> b")), "edges")
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    while not left.isEmpty():
        towards = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        towards = stage(towards, "pointers")
        over = towards.select(F.col("node").alias("up"), F.col("up").alias("over"))
        towards = towards.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("up"))
        labels = follow(labels, towards, "component")
        left = stage(_ordered(follow(follow(left, towards, "a"), towards, "b").filter("a <> b")), "edges")
    return stage(labels, "labels")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def follow(df: DataFrame, towards: DataFrame, column: str) -> DataFrame:
    """Replace ``column`` by what ``towards`` (``node``, ``up``) has for it, if anything."""
    steps = towards.select(F.col("node").alias(column), F.col("up").alias("_up"))
    joined = df.join(steps, column, "left")
    return joined.select(*[F.coalesce("_up", column).alias(column) if c == column else c for c in df.columns])
