"""Closures over edge tables by recursive SQL; cycles, ancestors and leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, *, case: str = "case_id", src: str = "src", dst: str = "dst", max_depth: int = 64) -> DataFrame:
    """case, src, dst, depth: all pairs joined by a path of one edge or more, with the least depth.

    Semi-naive: each round joins only the pairs of the round before. Paths of max_depth that would go
    on raise, so a result is never cut short silently.
    """
    from tallyloom.sources.shared import written

    step = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(case).alias("c"), F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    all_pairs = new = step.withColumn("depth", F.lit(1))
    for depth in range(2, max_depth + 2):
        more = new.join(step.select("c", F.col("s").alias("d"), F.col("d").alias("e")), ["c", "d"]).select("c", "s", F.col("e").alias("d")).distinct()
        more = written(more.join(all_pairs, ["c", "s", "d"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if more.isEmpty():
            break
        if depth > max_depth:
            raise RuntimeError(f"paths are longer than {max_depth}")
        new, all_pairs = more, written(all_pairs.unionByName(more), "pairs")
    return all_pairs.select(F.col("c").alias(case), F.col("s").alias(src), F.col("d").alias(dst), "depth")


def cycle_nodes(pairs: DataFrame, *, case: str = "case_id", src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes that reach themselves."""
    return pairs.where(F.col(src) == F.col(dst)).select(case, F.col(src).alias("node")).distinct()


def reaches(pairs: DataFrame, wanted: DataFrame, *, case: str, src: str, dst: str) -> DataFrame:
    """wanted rows with reached: an edge path, or the node itself."""
    p = pairs.select(F.col(case).alias("_c"), F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct().withColumn("_hit", F.lit(True))
    j = wanted.join(p, (F.col(case) == F.col("_c")) & (F.col(src) == F.col("_s")) & (F.col(dst) == F.col("_d")), "left")
    return j.select(*wanted.columns, (F.coalesce("_hit", F.lit(False)) | (F.col(src) == F.col(dst))).alias("reached"))


def leaves_under(pairs: DataFrame, leaves: DataFrame, *, case: str, src: str, dst: str, leaf: str) -> DataFrame:
    """case, src, leaves: the known leaves below each node, in order."""
    l = leaves.select(F.col(case), F.col(leaf).alias(dst)).distinct()
    return pairs.join(l, [case, dst]).groupBy(case, src).agg(F.array_sort(F.collect_set(dst)).alias("leaves"))


def producers(outputs: DataFrame, entities: DataFrame, *, entity: str, activity: str) -> DataFrame:
    """entity, producers: entities that no activity or more than one generates."""
    per = outputs.groupBy(entity).agg(F.array_sort(F.collect_set(activity)).alias("producers"))
    found = entities.select(entity).distinct().join(per, entity, "left").withColumn("producers", F.coalesce("producers", F.array().cast("array<string>")))
    return found.where(F.size("producers") != 1)
