"""Connected components by alternating large-star and small-star.

Each round writes its edges to the shared folder, so lineage does not grow. A node
with many neighbours is never gathered: its least neighbour comes from a partial
aggregate, and is joined back to its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.session import materialize_with


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of an edge (u, v).

    Edges may repeat, in either direction; loops and edges with a null are left out.
    """
    current = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = None
    while True:
        current, state = materialize_with(
            _small_star(_large_star(current)).where(F.col("u") != F.col("v")).distinct(),
            "star-edges",
            n=F.count(F.lit(1)),
            digest=F.bit_xor(F.xxhash64("u", "v")),
        )
        # Stars whose edges no longer change are the components.
        if state == seen or not state["n"]:
            break
        seen = state
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
