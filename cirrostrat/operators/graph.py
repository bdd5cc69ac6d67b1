"""Connected components by contraction under random priorities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrostrat.runtime import discard, materialize

#: Edges that one task joins up when the graph has shrunk so far (16 bytes each).
LAST_EDGES = 500_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the least node that each reaches.

    Roots hang on smaller roots next to them and pointers are followed to their ends, so at least half of the roots
    of every unfinished part go each time.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _join_up(table: pa.Table) -> pa.Table:
    nodes, root = least_reached(table.column("a").to_numpy(), table.column("b").to_numpy())
    return pa.table({"id": nodes, "to": root})


def joined_up(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``connected_components`` of at most ``LAST_EDGES`` edges, in one task."""
    e = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a is not null and b is not null").distinct().withColumn("rest", F.lit(0))
    return e.groupBy("rest").applyInArrow(_join_up, "id long, to long").withColumnRenamed("to", "component")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", last_edges: int = LAST_EDGES) -> DataFrame:
    """Label every node of ``edges`` (of long ids) with the smallest node that it reaches.

    Returns (id, component), one row per node that some edge names; edges with a null end are
    ignored, self-loops name their node, repeated edges count once, no edges give no rows.
    In each round nodes have random priorities; every node points to the first of itself and its
    neighbours (an aggregate that combines before the shuffle), then to that one's, and the graph
    shrinks to the nodes that are pointed to and the edges between different ones. Whatever the ids
    and the shape of the graph, only nodes first among their neighbours stay (a third of a path, fewer of
    denser graphs), so the rounds grow with the logarithm of the edges and cost about as much together as the first.
    Up to ``last_edges`` edges are joined up in one task. At last the pointers are followed back.
    """
    e = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null")
    left = materialize(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    levels: list[DataFrame] = []
    while left.count() > last_edges:
        both = left.union(left.select("b", "a"))
        first = F.struct(F.xxhash64("b", F.lit(len(levels))).alias("p"), F.col("b").alias("id"))
        own = F.struct(F.xxhash64("a", F.lit(len(levels))).alias("p"), F.col("a").alias("id"))
        points = materialize(both.groupBy("a").agg(F.min(F.least(first, own)).alias("m")).select(F.col("a").alias("id"), F.col("m.id").alias("p")), "points")
        to = materialize(points.join(points.select(F.col("id").alias("p"), F.col("p").alias("to")), "p").select("id", "to"), "level")
        discard(points)
        levels.append(to)
        moved = left.join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        shrunk = materialize(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(left)
        left = shrunk
    out = left.withColumn("rest", F.lit(0)).groupBy("rest").applyInArrow(_join_up, "id long, to long")
    if not levels:
        return materialize(out.select("id", F.col("to").alias("component")), "labels")
    out = materialize(out, "labels")
    for level in reversed(levels):
        up = out.select(F.col("id").alias("to"), F.col("to").alias("top"))
        out, old = materialize(level.join(up, "to", "left").select("id", F.coalesce("top", "to").alias("to")), "labels"), out
        discard(old, level)
    least = out.groupBy("to").agg(F.min("id").alias("component"))  # priorities led to any node of a component
    return materialize(out.join(least, "to").select("id", "component"), "labels")
