"""Connected components by alternating large-star and small-star.

Edges are (u, v) rows of longs. Rounds end with the first forest of stars, which
a further round would leave as it is; edges that are one already need none. Each round writes its edges to a table in the
shared folder; a node's smallest neighbour is found by a pre-aggregated,
salted lookup, so a node that a third of all edges touch stays spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_table, key_extreme, salted, table


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """pairs: directed (u, v). Links v to the smallest node m of u and its neighbours.

    large-star: every v over u; small-star: every v up to u, and u itself.
    """
    least = key_extreme(pairs, ["u"], "v", F.col("v"), F.min)
    near = salted(pairs, F.col("v")).join(least, ["u", "_salt"]).withColumn("m", F.least("u", "_extreme"))
    if larger:
        return near.where("v > u").select(F.col("m").alias("u"), "v")
    return near.select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every larger node has one edge and is nobody's smaller node, for distinct edges u < v."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(1).alias("leaf")))).alias("e"))
    nodes = ends.select("e.*").groupBy("node").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("least"))
    return nodes.where("leaves > 1 OR (leaves = 1 AND least = 0)").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Self-loops and repeated edges are ignored; no edges give no rows. RuntimeError
    if ``rounds`` do not suffice (they grow with the logarithm of the size).
    """
    kept = table(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges")
    for _ in range(rounds):
        if _is_forest_of_stars(kept):
            break
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = table(_star(both, True).where("u < v").distinct(), "large-star")
        # small-star: pairs point from the larger node to its smaller neighbours
        small = table(_star(large.select(F.col("v").alias("u"), F.col("u").alias("v")), False).where("u < v").distinct(), "small-star")
        drop_table(kept)
        drop_table(large)
        kept = small
    else:
        if not _is_forest_of_stars(kept):
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = kept.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return kept.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(root)
