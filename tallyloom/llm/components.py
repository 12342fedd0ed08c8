"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every round is
two aggregations with map-side combine and two joins on node keys; nothing is collected.
A hub with very many edges is one row on the side of the minima, which is a written table,
so that Spark's skew join can split the rows on its other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def connected_components(edges: DataFrame, src: str, dst: str, *, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node that has an edge to another one.

    Keys of any ordered type; edges are undirected; self-loops, repeated edges and edges with
    a null end are ignored. The result is a written table of one row per node. Rounds end when every
    node has either larger neighbours only, or one neighbour, which is smaller: then all edges are stars.
    Repeated edges do no harm: a round adds one row a node at most.
    """
    now = Written(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))), "edges"
    )
    low_of = F.when(F.col("v") < F.col("u"), F.col("v"))
    for _ in range(max_rounds):
        counts = [F.min("v").alias("m"), F.min(low_of).alias("first"), F.max(low_of).alias("last"), F.max("v").alias("top")]
        least = Written(_both_ways(now.df).groupBy("u").agg(*counts), "least")
        if least.df.where("first < last OR first IS NOT NULL AND top > u").isEmpty():
            now.drop()
            return least.df.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
        # large star: each node links its larger neighbours to its smallest neighbour or itself
        large = Written(_both_ways(now.df).where("v > u").join(least.df.select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # small star: each node links itself and its smaller neighbours to the smallest of them
        low = Written(large.df.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.df.join(low.df, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = Written(moved.unionAll(low.df.select("u", F.col("m").alias("v"))), "stars")
        for held in (now, least, large, low):
            held.drop()
        now = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
