"""Attempts as a stream: resumable processing, last states and first outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructType


def attempts_stream(spark: SparkSession, path: str, schema: StructType | str, *, fmt: str = "json", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def run_available(rows: DataFrame, process: Callable[[DataFrame], DataFrame], sink: str, *, key: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a batch writes to a folder named by its number.

    A batch that is run again after a failure overwrites its own folder, and keys that earlier
    batches have written are left out, so that each key has one result.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates([key])
        done = _others(spark, sink, number)
        if done is not None:
            fresh = fresh.join(done.select(key).distinct(), key, "left_anti")
        process(fresh).write.mode("overwrite").parquet(f"{sink}/batch={number:09d}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstOfKey(StatefulProcessor):
    """A key's fingerprint is its state; the first row of a new key goes on, later ones with the same fingerprint don't, another fingerprint fails the query."""

    def __init__(self, fingerprint: str, order: str):
        self.fingerprint, self.order = fingerprint, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "fingerprint string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        known = self.held.get()[0] if self.held.exists() else None
        first = None
        for part in rows:  # one part at a time, however many rows a key has
            marks = part[self.fingerprint]
            known = marks.iloc[0] if known is None else known
            if (marks != known).any():
                raise ValueError(f"results of {key[0]!r} belong to another configuration: {known}, {marks[marks != known].iloc[0]}")
            least = part.nsmallest(1, self.order)
            first = least if first is None or least[self.order].iloc[0] < first[self.order].iloc[0] else first
        if not self.held.exists():
            self.held.update((known,))
            yield first

    def close(self) -> None:
        pass


def once_per_key(rows: DataFrame, *, key: str, fingerprint: str, order: str) -> DataFrame:
    """The first row of each key of a stream, by `order` within its batch; a key that comes again with another fingerprint fails the query.

    What has been seen is in the state store, so a batch costs its own rows, however much was done before. Repeats within an Arrow batch go before the shuffle,
    so that a hot key is a few rows a task. key, fingerprint (a string) and order (a number) must not be null. The session needs the RocksDB state store (see ROCKS).
    """
    if rows.schema[fingerprint].dataType != StringType():
        raise ValueError("the fingerprint is a string")
    slim = rows.mapInPandas(lambda parts: (p.sort_values(order, kind="stable").drop_duplicates([key, fingerprint]) for p in parts), rows.schema)
    return slim.groupBy(key).transformWithStateInPandas(_FirstOfKey(fingerprint, order), rows.schema, "Append", "None")


def run_once_per_key(rows: DataFrame, process: Callable[[DataFrame], DataFrame], sink: str, *, key: str, fingerprint: str, order: str, checkpoint: str) -> StreamingQuery:
    """Process each key of what is there once, and stop: the state says which keys are done, the file sink's log which files count.

    process works on rows as a stream (columns and joins with tables, no aggregation). A run that dies is taken up at its batch: files it left are not in the
    log, and the state is that of the last whole batch, so in the end each key has one result.
    """
    done = process(once_per_key(rows, key=key, fingerprint=fingerprint, order=order))
    return done.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _others(spark: SparkSession, sink: str, number: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(sink).where(F.col("batch") != number)


def event_windows(events: DataFrame, *, at: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """window start, by..., n, total: counts per event-time window; later rows than `late` are left out by the watermark."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), *by, "n", "total")


def first_outcomes(attempts: DataFrame, *, key: str, order: str, observed: Column) -> DataFrame:
    """Update-mode state of each key: its first observed attempt so far and the failures before it."""
    rows = attempts.select(key, F.col(order).alias("_at"), observed.alias("_seen"), F.struct(*attempts.columns).alias("_row"))
    return rows.groupBy(key).agg(F.min_by("_row", F.when(F.col("_seen"), F.col("_at"))).alias("outcome"), F.count_if(~F.col("_seen")).alias("unobserved"), F.count("*").alias("attempts"))


def last_states(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Update-mode ledger: first and last time and the last row of each key."""
    return events.groupBy(*keys).agg(F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.max_by(F.struct(*events.columns), at).alias("state"))
