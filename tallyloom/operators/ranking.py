"""Ranks, first occurrences, contiguity and keep-first rules as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.sources.shared import written


def top_k_flags(rows: DataFrame, *, by: str, order: list[Column], item: str, hit: Column, k: int) -> DataFrame:
    """by, lowest_rank, top1 (item of the lowest rank), top1_hit, topk_hit, k (rows kept)."""
    ranked = rows.select(by, item, hit.alias("_hit"), F.row_number().over(Window.partitionBy(by).orderBy(*order)).alias("_rank")).where(F.col("_rank") <= k)
    return ranked.groupBy(by).agg(
        F.min("_rank").alias("lowest_rank"), F.min_by(item, "_rank").alias("top1"), F.bool_or(F.col("_hit") & (F.col("_rank") == 1)).alias("top1_hit"), F.bool_or("_hit").alias("topk_hit"), F.count("*").alias("k")
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column], *, limit: int = 1) -> DataFrame:
    """The first rows of each key; a limit of 0 keeps all."""
    if limit <= 0:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def last_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the largest order value of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    """key, place: distinct keys numbered from 1 by their first position."""
    first = rows.groupBy(key).agg(F.min(position).alias("_first"))
    return numbered(first, ["_first", key], "place").select(key, "place")


def numbered(rows: DataFrame, order: list[str], name: str = "line_number") -> DataFrame:
    """Rows with their place from 1 in the order of the columns, which must be a total one for a defined result.

    Rows are sorted by ranges; a place is the rows of earlier ranges and the place in its own. No task holds more
    than a range, and the ranges are written once, so that a retry numbers alike.
    """
    sorted_rows = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    kept = written(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    return kept.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + place + 1).cast("bigint")).drop("_id", "_part", "_start")


def ranks_contiguous(ranks: Column) -> Column:
    """Exactly 1..n in some order."""
    return F.array_sort(ranks) == F.when(F.size(ranks) > 0, F.sequence(F.lit(1), F.size(ranks))).otherwise(F.array().cast("array<int>"))


def not_increasing(values: Column) -> Column:
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(values) - 1, F.lit(1))), lambda i: F.coalesce(F.get(values, i) <= F.get(values, i - 1), F.lit(True)))


def next_number(existing: Column) -> Column:
    """max + 1 in three digits, 001 for none."""
    return F.lpad((F.coalesce(F.max(existing), F.lit(0)) + 1).cast("string"), 3, "0")


def select_sources(tasks: DataFrame, *, offset: int = 0, limit: int = 0, variants: list[int] | None = None, sample: str = "sample_id", position: str = "line_no") -> DataFrame:
    """Tasks of a range of sources in order of first occurrence, and of some variants; a limit of 0 takes all."""
    parts = tasks.withColumn("source_id", F.regexp_extract(sample, r"^(.*)--v[0-9]{3}$", 1)).withColumn("variant", F.regexp_extract(sample, r"--v([0-9]{3})$", 1).cast("int"))
    places = ordered_distinct(parts, "source_id", position).where(F.col("place") > offset)
    places = places.where(F.col("place") <= offset + limit) if limit > 0 else places
    kept = parts if variants is None else parts.where(F.col("variant").isin(*variants))
    return kept.join(places.select("source_id"), "source_id", "left_semi")
