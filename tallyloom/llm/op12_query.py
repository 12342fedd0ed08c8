"""op12: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import table
from tallyloom.llm.language_id import predicted


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(table(spark, sf_dir, "documents"))
