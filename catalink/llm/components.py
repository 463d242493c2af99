"""Connected components by alternating large-star and small-star rounds, each one written to the shared folder.

Cases: no edges give no rows; links of a node with itself, repeated and turned links change nothing; nodes are
longs and never null; a hub of any degree is a join key that Spark may split, never one group of a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to their smallest; hubs are joined, so that Spark can split them."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("n"), "m")
    held = sides.join(least, F.col("u") == F.col("n"))
    if large:
        out = held.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = held.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u long, v long); root is the smallest node reachable.

    Self-links and repeated or turned links are allowed; no edges give no rows.
    """
    edges = written(edges.where("u != v").distinct(), "edges")
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS if mark[0] else 0):
        edges = written(_star(_star(edges, True), False), "edges")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
