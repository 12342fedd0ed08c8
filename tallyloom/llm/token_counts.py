"""Exact histogram of encoded lengths; suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import fresh
from tallyloom.llm.tokens import encoder, slices, tokenizer_path


#: What reports hold besides the by columns; a name that one of those has gets underscores before it.
COUNTS = ("length", "n_docs", "n_tokens", "docs_upto", "docs_over", "tokens_total", "truncated_total", "share_upto")


def _named(by: tuple[str, ...]) -> dict[str, str]:
    return {c: fresh(list(by), c) for c in COUNTS}


def _keys(by: tuple[str, ...]) -> list[str]:
    """Names of the by columns inside the operator, so that theirs can be any."""
    return [f"_by{i}" for i in range(len(by))]


def encoded_lengths(docs: DataFrame, *, text: str = "text", by: tuple[str, ...] = (), tokenizer: str | None = None) -> DataFrame:
    """One row per document: the by columns and length, its number of ids. A null text has none."""
    path, keys = tokenizer or tokenizer_path(), _keys(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                _, _, ends, _ = enc.encode(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(ends))], names=[*keys, "length"])

    slim = docs.select(docs[text].alias("_text"), *[docs[c].alias(k) for c, k in zip(by, keys)])
    kinds = ", ".join([*(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys), "length bigint"])
    return slim.mapInArrow(run, kinds).toDF(*by, _named(by)["length"])


def length_histogram(docs: DataFrame, *, text: str = "text", by: tuple[str, ...] = (), tokenizer: str | None = None) -> DataFrame:
    """by..., length, n_docs: the whole distribution, aggregated before it is shuffled.

    Null and empty texts have length 0; texts of any length are encoded whole, in one task each; repeated rows count each; a null in a
    by column is a group of its own; empty tables give no rows; other columns are not read. By columns may have any names: one called
    like a column of the result keeps its name, and the other gets underscores before it.
    """
    lengths = encoded_lengths(docs, text=text, by=by, tokenizer=tokenizer).toDF(*_keys(by), "length")
    return lengths.groupBy(*_keys(by), "length").agg(F.count("*").alias("n_docs")).toDF(*by, *(_named(by)[c] for c in ("length", "n_docs")))


def length_report(hist: DataFrame, *, by: tuple[str, ...] = (), block: int = 256) -> DataFrame:
    """For each length that occurs, taken as a context limit: what a suffix sum gives.

    by..., length, n_docs, n_tokens, docs_upto, docs_over, tokens_total, truncated_total (tokens
    left when each document is cut to the limit), share_upto (of documents; the q-quantile is the
    least length with share_upto >= q). Sums run within blocks of lengths and over the blocks.
    """
    names, own = _named(by), by
    hist, by = hist.select(*[hist[c].alias(k) for c, k in zip(by, _keys(by))], *[hist[names[c]].alias(c) for c in ("length", "n_docs")]), tuple(_keys(by))
    rows = hist.select(*by, "length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / block).alias("_block"))
    blocks = rows.groupBy(*by, "_block").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    blocks = blocks.select(
        *by, "_block", zero(F.sum("_d").over(before)).alias("_d0"), zero(F.sum("_t").over(before)).alias("_t0"),
        F.sum("_d").over(whole).alias("_docs"), F.sum("_t").over(whole).alias("tokens_total"),
    )
    same = None
    for c in by:
        same = rows[c].eqNullSafe(blocks[c]) if same is None else same & rows[c].eqNullSafe(blocks[c])
    on = rows["_block"] == blocks["_block"]
    inside = Window.partitionBy(*[rows[c] for c in by], rows["_block"]).orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(blocks, on if same is None else on & same).select(
        *[rows[c] for c in by], "length", "n_docs", "n_tokens", "tokens_total", "_docs",
        (F.col("_d0") + F.sum("n_docs").over(inside)).alias("docs_upto"), (F.col("_t0") + F.sum("n_tokens").over(inside)).alias("_tokens_upto"),
    )
    over = F.col("_docs") - F.col("docs_upto")
    return joined.select(
        *by, "length", "n_docs", "n_tokens", "docs_upto", over.alias("docs_over"), "tokens_total",
        (F.col("_tokens_upto") + F.col("length") * over).alias("truncated_total"), (F.col("docs_upto") / F.col("_docs")).alias("share_upto"),
    ).toDF(*own, *(names[c] for c in COUNTS))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: tokens kept if every document is cut to any limit, one that no document has included."""
    return hist.agg(F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_total"))


def length_quantile(report: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least the share q of documents doesn't exceed (null for no documents)."""
    return report.where(F.col("share_upto") >= q).agg(F.min("length").alias("length"))
