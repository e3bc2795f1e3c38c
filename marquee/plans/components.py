"""Connected components of an edge table by alternating large-star and small-star steps.

Each step keeps, per vertex, only its smallest neighbour (an aggregate with map-side
partials, no neighbour lists), so a hub with a third of all edges costs no task its
whole star.  Rounds grow with the logarithm of the graph; each is written to the
shared checkpoint folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.plans.lineage import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v.  One step; the vertices' components stay the same."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(vertex, component) of every vertex of ``links`` (a, b longs); component: its smallest vertex.

    Self links and nulls are left out; an empty table gives an empty one."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    last = None
    while True:
        edges = materialize(_star(_star(edges, True), False), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
