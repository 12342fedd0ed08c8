"""op6: the length report of all documents for each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import table, written
from tallyloom.llm.token_counts import length_histogram, length_report


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(length_histogram(table(spark, sf_dir, "documents"), by=("lang",)), "lengths")  # read twice
    return length_report(counts, by=("lang",))
