"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.skew import join_one_per_key
from caseloom.session import cut_lineage


def star_edges(members: DataFrame, node: str, key: str) -> DataFrame:
    """Edges (u, v) that join every node of a key to the smallest one: linear in the members of a key.

    Rows with a null node or key tie nothing; a repeated member repeats its edge.
    """
    kept = members.select(F.col(node).alias("u"), F.col(key).alias("k")).where("u is not null and k is not null")
    least = kept.groupBy("k").agg(F.min("u").alias("v"))
    return join_one_per_key(kept, least, "k").where("u <> v").select("u", "v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least of its neighbours and itself; edges have u > v."""
    ends = edges.select("v", F.col("v").alias("w")).unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("w")))
    least = ends.groupBy("v").agg(F.min("w").alias("least"))
    return join_one_per_key(edges, least, "v").select("u", F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the least of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = join_one_per_key(edges, least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionAll(least.select("u", F.col("least").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, or only larger ones: then the edges are one star a component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or up + down > 1").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component is named by its smallest node.

    Alternating large-star and small-star steps: every round is two map-side combined minima, each joined back so that the
    edges of a hub can be split, and one distinct; the number of rounds grows with the logarithm of the largest component. Lineage is
    cut by a reliable checkpoint each round; only one flag a round reaches the driver. Loops and null
    ends are dropped; repeated edges change nothing; an empty input gives an empty result.
    """
    now = edges.where("u is not null and v is not null and u <> v")
    now = cut_lineage(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = cut_lineage(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
