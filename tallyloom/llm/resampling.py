"""Resampling towards a target distribution by importance weights.

As in Xie et al., "Data Selection for Language Models via Importance Resampling" (2023): documents and target texts are
bags of hashed word n-grams, a document's weight is the mean of its features' log ratios, and the greatest weights plus
Gumbel noise are a sample without replacement. Log ratios, weights and noise are integers (thousandths), so that the
number of documents of each score is an exact histogram of bounded size: its suffix sums give the rank at which every
score begins and the score at which the draw ends; only documents of scores that survive are numbered, within their score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tallyloom.llm.common import Written, give_back

#: Bytes of words are 0-9, a-z and all of characters beyond ASCII; A-Z become a-z, others separate.
WORD_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Features in one batch of results, or those of one text, if it has more.
BATCH = 1 << 20
#: Tasks that add up the counts of all others, and scores in a block of the histogram.
ADDERS, BLOCK = 16, 256


@dataclass(frozen=True)
class Draw:
    """percent of the documents with at least min_words words are drawn; runs of 1 to grams words are hashed into buckets."""

    buckets: int = 10_000
    grams: int = 2
    min_words: int = 20
    percent: int = 25
    seed: int = 7


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def hashed(found: list[bytes], draw: Draw) -> list[int]:
    """Buckets of all runs of 1 to grams words, joined by a space; a run's CRC-32 goes on from that of its first words."""
    spaced, runs = [b" " + w for w in found], list(map(crc32, found))
    out = runs
    for n in range(1, min(draw.grams, len(found))):
        runs = list(map(crc32, spaced[n:], runs))
        out = out + runs
    return out


def featured(docs: DataFrame, draw: Draw, *, doc_id: str | None, text: str = "text") -> DataFrame:
    """_id (of doc_id), n_words, buckets: the whole text's features. A null text has none."""
    slim = docs.select(F.col(text).cast("binary").alias("_text"), *([F.col(doc_id).alias("_id")] if doc_id else []))
    kind = StructType([*slim.schema.fields[1:], StructField("n_words", LongType()), StructField("buckets", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, sizes, counts, parts = 0, [], [], []
            for i, value in enumerate(batch.column(0)):
                found = words(value.as_py() or b"")
                own = np.array(hashed(found, draw), np.uint32) % np.uint32(draw.buckets)
                sizes.append(len(own))
                counts.append(len(found))
                parts.append(own.astype(np.int32))
                if sum(sizes) >= BATCH or i == len(batch) - 1:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(parts)))
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, len(sizes)) for c in batch.columns[1:]), pa.array(counts, pa.int64()), lists], names=kind.names)
                    start, sizes, counts, parts = i + 1, [], [], []
        give_back()

    return slim.mapInArrow(run, kind)


def bucket_counts(features: DataFrame, draw: Draw) -> np.ndarray:
    """How often each bucket occurs in all rows: vectors of one task each, added up by ADDERS tasks; the driver gets theirs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=draw.buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    rows = features.select("buckets").mapInArrow(count, "counts binary").repartition(ADDERS).mapInArrow(add, "counts binary").collect()
    return np.sum([np.frombuffer(r.counts, np.int64) for r in rows] or [np.zeros(draw.buckets, np.int64)], axis=0)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed target share / smoothed raw share)) of every bucket, computed in doubles."""
    n, s, t = float(len(raw)), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1.0) * (s + n)) / ((a + 1.0) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """_id, n_words, n_features, weight: the floored mean of a document's gains, 0 for no features."""
    kind = StructType([*features.select("_id", "n_words").schema.fields, StructField("n_features", LongType()), StructField("weight", LongType())])
    shared = features.sparkSession.sparkContext.broadcast(gain)  # a long for each bucket, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.asarray(lists.offsets, dtype=np.int64)
            sums = np.concatenate([[0], np.cumsum(shared.value[lists.values.to_numpy()[: ends[-1]]])])
            n = np.diff(ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array((sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1))], names=kind.names)

    return features.select("_id", "n_words", "buckets").mapInArrow(run, kind)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of SHA-256 of `seed:id` (a null id is written null)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def rank_offsets(scores: DataFrame) -> DataFrame:
    """score, n, above: documents of the score and of all greater scores, from suffix sums within blocks of scores and over the blocks."""
    hist = scores.groupBy("score").agg(F.count("*").alias("n")).withColumn("_block", F.floor(F.col("score") / BLOCK))
    blocks = hist.groupBy("_block").agg(F.sum("n").alias("_n"))
    later = lambda by, n: F.coalesce(F.sum(n).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = blocks.select("_block", later(Window.orderBy(F.desc("_block")), "_n").alias("_over"))
    inside = later(Window.partitionBy("_block").orderBy(F.desc("score")), "n")
    return hist.join(F.broadcast(over), "_block").select("score", "n", (F.col("_over") + inside).cast("long").alias("above"))


def resampled(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1 in the order drawn, null for documents not drawn): one row for each row of docs.

    Null and empty texts have no features, weight 0, and are never drawn. Texts of any length are read whole; one text's
    features must fit into one row (4 bytes each). Equal scores go by the smaller id, nulls first, then n_features and weight;
    repeated rows are documents of their own. A null id is written `null` for the noise. Without documents there are no rows;
    without target texts all target counts are 0. Only the id and the text are read, so other columns may have any names.

    Scores are integers between bounds that grow with the logarithm of the counts (some 10^5 at 10^15 features), which
    bounds the histogram, the part of it that is broadcast, and its blocks. A score is that of few documents, since
    noise spreads equal weights over thousands of scores.
    """
    kept = Written(featured(docs, draw, doc_id=doc_id, text=text), "features")
    gain = gains(bucket_counts(kept.df, draw), bucket_counts(featured(target, draw, doc_id=None, text=target_text), draw))
    scored = weighed(kept.df, gain).withColumn("score", F.col("weight") + gumbel(F.col("_id"), draw.seed))
    scored = Written(scored, "scored").df
    kept.drop()
    may = F.col("n_words") >= draw.min_words
    offsets = Written(rank_offsets(scored.where(may)), "offsets").df
    limit = draw.percent * (offsets.agg(F.sum("n")).first()[0] or 0) // 100
    surviving = F.broadcast(offsets.where(F.col("above") < limit).select(F.col("score").alias("_score"), "above"))
    marked = scored.join(surviving, may & (F.col("score") == F.col("_score")), "left")
    names = [F.col("_id").alias(doc_id), "n_features", "weight", "score"]
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("_id"), "n_features", "weight"))
    ranked = marked.where("above IS NOT NULL").select(*names, F.when(place <= limit, place).cast("long").alias("rank"))
    return ranked.unionByName(marked.where("above IS NULL").select(*names, F.lit(None).cast("long").alias("rank")))
