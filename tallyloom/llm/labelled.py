"""Labelled rows for fitting: folds by CRC-32 of the id, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, held_out: int, max_rows: int, seed: int = 1) -> DataFrame:
    """text, label (0 or 1): at most max_rows documents outside the held-out fold, those with the least hashes of their ids.

    An id gives one row: of several texts the least one (null is empty). Ids with both labels, without a label or
    without an id are left out. Only the id list, of proven size, is broadcast.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    ids = ids.groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"), F.max(label).cast("int").alias("_other")).where("_label = _other").drop("_other")
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("label")).select("text", "label")
