"""Bounded reachability over an edge table (src, dst, ord), where ord orders the edges of a source.

All operators keep paths as arrays of node ids and orders as arrays of edge ordinals. Arrays compare lexicographically,
so the order of ``ords`` is the pre-order of a depth-first traversal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatecrest.operators.checkpoints import cut

MAX_NODES = 20


def _start(roots: DataFrame) -> DataFrame:
    return roots.select("root", F.col("root").alias("node"), F.array("root").alias("path"), F.array(F.lit(0).cast("int")).alias("ords"))


def _step(frontier: DataFrame, edges: DataFrame, guard: bool = True) -> DataFrame:
    """One hop further along every edge; guard: not to a node that the path holds already."""
    e = edges.select(F.col("src").alias("node"), "dst", F.col("ord").cast("int").alias("ord"))
    out = frontier.join(e, "node")
    if guard:
        out = out.where(~F.array_contains("path", F.col("dst")))
    return out.select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("ords", F.array("ord")).alias("ords"))


def simple_paths(roots: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(root, node, path, ords) of every simple path of at most ``max_nodes`` nodes; a root reaches itself. One job a hop."""
    frontier = cut(_start(roots.select("root").distinct()))
    found = frontier
    for _ in range(max_nodes - 1):
        frontier = cut(_step(frontier, edges))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def first_paths(roots: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(root, node, path, ords): for each node that a root reaches, its first simple path in depth-first order.

    Keeps the least path so far for each root and node and extends the improved ones until none improves. A root for
    which some least path has more than ``max_nodes`` nodes is enumerated with that bound instead.
    """
    best = cut(_start(roots.select("root").distinct()))
    fresh = best
    pick = Window.partitionBy("root", "node").orderBy("ords")
    while True:
        new = cut(_step(fresh, edges).withColumn("r", F.row_number().over(pick)).where("r = 1").drop("r"))
        old = best.select("root", "node", F.col("ords").alias("old"))
        fresh = cut(new.join(old, ["root", "node"], "left").where("old is null or ords < old").drop("old"))
        if fresh.isEmpty():
            break
        best = cut(best.unionByName(fresh).withColumn("r", F.row_number().over(pick)).where("r = 1").drop("r"))
    long = cut(best.where(F.size("path") > max_nodes).select("root").distinct())
    if long.isEmpty():
        return best
    exact = simple_paths(long, edges, max_nodes).withColumn("r", F.row_number().over(pick)).where("r = 1").drop("r")
    return best.join(long, "root", "left_anti").unionByName(exact)


def shortest_paths(roots: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, path, ords, depth): breadth first, one path for each node; of equally short ones the first in order."""
    frontier = cut(_start(roots.select("root").distinct()).withColumn("depth", F.lit(0)))
    found, depth = frontier, 0
    pick = Window.partitionBy("root", "node").orderBy("ords")
    while max_depth is None or depth < max_depth:
        depth += 1
        new = _step(frontier.drop("depth"), edges, guard=False).join(found.select("root", "node"), ["root", "node"], "left_anti")
        frontier = cut(new.withColumn("r", F.row_number().over(pick)).where("r = 1").drop("r").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    return found


def unreached(roots: DataFrame, reached: DataFrame) -> DataFrame:
    """Roots without a row in reached (root, ...)."""
    return roots.join(reached.select("root").distinct(), "root", "left_anti")
