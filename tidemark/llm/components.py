"""Connected components of large graphs by alternating star contractions.

Large-star links each node's larger neighbours to the smallest node it sees,
small-star its smaller ones; after a number of rounds that grows with the
logarithm of the longest path, every component is a star around its smallest
node. Neighbour minima are found with salted aggregation, so a hub with any
number of edges is never in one task, and each round is written to the shared
folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node, which has none itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.max("e.down").alias("downs")).where("ups > 1 or (ups = 1 and downs = 1)").isEmpty()


def connected(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """(node, ``label``) for every node of ``edges`` (columns a, b of one orderable type); label: the component's smallest node.

    Self-loops and repeated edges are allowed; rows with a null end are ignored.
    """
    ordered = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, made = common.measured(ordered.distinct(), "edges", n=F.count(F.lit(1)))
    for _ in range(rounds):
        if not made["n"] or _is_stars(now):
            break
        salt = F.pmod(F.xxhash64("v"), F.lit(common.salts_for(made["n"])))
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        seen = common.with_group_stats(both, ["u"], {"low": ("min", F.col("v"))}, salt)
        large = seen.where("v > u").select(F.col("v").alias("u"), F.least("low", "u").alias("v")).where("u <> v")
        seen = common.with_group_stats(large, ["u"], {"low": ("min", F.col("v"))}, salt)
        small = seen.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
        before = now
        now, made = common.measured(small.select("e.u", "e.v").where("u <> v").distinct(), "edges", n=F.count(F.lit(1)))
        common.drop(before)
    else:
        raise RuntimeError(f"components not found within {rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias(label))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias(label)).distinct())
