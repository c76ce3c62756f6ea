"""Connected components of an undirected graph given as an edge table, by alternating large-star and small-star rounds.

No step gathers a node's neighbours: each round takes a minimum per node with partial aggregation and joins it back to the
edges, so a hub is a skewed join key, which adaptive execution splits. Rounds are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmesa.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large-star sees each edge from both ends and moves larger neighbours to the minimum; small-star moves smaller ones."""
    seen = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    # Written, so that the join deals both sides itself and can split a hub's partition.
    least = written(least, "least")
    joined = seen.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = written(moved.where("u != v").distinct(), "edges")
    discard(least)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge to another node are absent. Rounds end when the edges, compared by 128 bits of hashes and their number, stay."""
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        large = _star(now, True)
        following = _star(large, False)
        discard(now, large)
        now = following
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).head()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
