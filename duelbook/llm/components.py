"""Connected components of an edge table by alternating star steps; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.session import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of the node and its neighbours."""
    both = _both(edges)
    least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("m"))
    return both.where("dst > src").join(least, "src").select(F.col("m").alias("src"), "dst").where("src < dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them. Edges run from the smaller to the larger."""
    least = edges.groupBy("dst").agg(F.min("src").alias("m"))
    joined = edges.join(least, "dst")
    return joined.select(F.col("m").alias("src"), F.col("src").alias("_x"), "dst").select(
        "src", F.explode(F.array("_x", "dst")).alias("dst")).where("src < dst").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of (src < dst); the label is the smallest node of its component.

    A hub's edges are grouped with map-side minima and joined with splits of large partitions, so a node of any degree is
    spread over tasks. Ends when a pair of steps changes nothing; that takes about log2 of the longest path.
    """
    current = cut(edges.select("src", "dst").distinct())
    state = None
    for _ in range(rounds):
        after = cut(_small_star(_large_star(current)))
        digest = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        current = after
        if (digest["n"], digest["h"]) == state:
            return current.select(F.col("dst").alias("node"), F.col("src").alias("label")).union(
                current.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct())
        state = (digest["n"], digest["h"])
    raise RuntimeError(f"components did not settle in {rounds} rounds")
