"""Shared plumbing: tables, written intermediate tables, escaping of column clashes."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset (tests in local mode) a temporary folder is set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _delete_at_end(spark: SparkSession, place: str) -> None:
    """Hadoop deletes the path when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables written inside go to a folder of their own, which is deleted at the end.

    What is returned must not read them any more: write it with outside=True.
    """
    place = f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"
    token = _scratch.set(place)
    try:
        yield
    finally:
        _scratch.reset(token)
        _delete(spark, place)


class Written:
    """An intermediate result as a Parquet table in the shared folder; it survives lost executors.

    It goes with its scratch folder, by drop(), or at the latest when the driver ends.
    """

    def __init__(self, df: DataFrame, name: str, *, outside: bool = False):
        spark = df.sparkSession
        within = None if outside else _scratch.get()
        self.path = f"{within or shared_dir(spark) + '/tallyloom'}/{name}-{uuid.uuid4().hex}"
        if not within:
            _delete_at_end(spark, self.path)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; call it only when nothing reads the table any more."""
        _delete(self.df.sparkSession, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df


def per_process(key: str, make: Callable[[], Any]) -> Any:
    """A value made once in each Python process, whatever task asks for it."""
    store = sys.modules.setdefault("_tallyloom_process", types.ModuleType("_tallyloom_process")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def fresh(taken: list[str], name: str) -> str:
    """A column name that the input doesn't use (compared without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Return freed memory to the system at the end of a Python task; workers live on and would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
