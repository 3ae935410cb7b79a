"""Connected components of a link table, by alternating large-star and small-star rounds on Spark.

Each round is two grouped minima and two equi-joins; its edges are written to the shared checkpoint folder, so a lost executor
re-reads files. Nothing is gathered on the driver except two counters per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votepanel.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v <= u")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    j = both.join(low, "u")
    if large:
        out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(u, v)`` (any order, repeats and loops allowed) -> ``(node, component)``, component = smallest node reachable.

    Only nodes with a link to another node are returned. Null ends are ignored. An empty table gives an empty table.
    """
    edges = links.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        edges = cut_lineage(_star(_star(edges, True), False), "edges")
        # a fixed point is reached when a round leaves the same set of edges: count and an order-free checksum
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
