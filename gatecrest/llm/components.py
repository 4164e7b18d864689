"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecrest.llm.common import cut

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over (u, v). Large: each node sends its larger neighbours to its least one; small: its smaller ones and itself."""
    if large:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        out = pairs.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = pairs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its least node.

    Edges with a null end and self-loops connect nothing: a node that has only such edges is left out. Repeated edges
    count once. No edges give no rows. Every round is checkpointed in the shared folder, and the rounds end when the
    edge set no longer changes. u and v have one type, which orders the nodes.
    """
    e = cut(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        e = cut(_star(_star(e, True), False))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
