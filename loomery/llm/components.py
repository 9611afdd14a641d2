"""Connected components by alternating large-star and small-star steps, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import cut

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (u, v); a component is its smallest node.

    Self-loops and repeated edges change nothing; edges with a null end are left out. Each round is cut at a checkpoint.
    A hub's edges meet its minimum in an equi-join, which adaptive execution splits where it is skewed, and edges point
    to ever smaller nodes, so rounds grow with the logarithm of a component's length.
    """
    now = cut(_ordered(edges.select("u", "v")))
    before = None
    for _ in range(ROUNDS):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        now = cut(_small_star(_large_star(now)))
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    leaves = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return leaves.unionByName(roots.join(leaves, "node", "left_anti"))


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node among itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _ordered(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _ordered(linked.unionByName(least.select("u", F.col("m").alias("v"))))
