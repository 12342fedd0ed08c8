"""The corpus pipeline: quality, toxicity, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import mixing, near_duplicates, packing, quality, toxicity
from tallyloom.llm.common import Written, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality score below 0.7 go. The classifier is fitted on a bounded sample of the labelled documents."""
    settings = quality.Settings()
    scored = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels"), settings=settings))
    return scored.where(F.col(scored.columns[-1]) >= settings.accept).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score of 0.5 or more go."""
    scored = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the least doc_id."""
    return near_duplicates.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn, each at most once, with the probabilities that meet the target shares of source, language and topic."""
    return mixing.mixed(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their place in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Classifiers, alignment and tokenizers have no form in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. A stage's copy goes when the next one's is written, the last when the driver ends."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        new = Written(stage(spark, docs, sf_dir), name)
        if held is not None:
            held.drop()
        docs, held = new.df, new
    return docs
