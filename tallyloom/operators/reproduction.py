"""Recomputation of published intervals from scored rows: web scores only, in the order of a private mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.scoring import BOTTOM
from tallyloom.operators.statistics import DECISIONS, aligned, paired_bootstrap
from tallyloom.operators.tasks import by_ordinal, published
from tallyloom.sources.shared import written


def _holds(rows: DataFrame, fine: Column, message: Column | str) -> DataFrame:
    """rows, or a failed query at one that isn't fine."""
    return rows.where(F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message) if isinstance(message, str) else message).cast("boolean")))


def web_only(scored: DataFrame, mapping: DataFrame, figures: DataFrame, draws: DataFrame, types: tuple[str, ...], *, decisions: tuple[str, ...] = DECISIONS, tolerance: float = 1e-12) -> DataFrame:
    """model, metric, point, ci_low, ci_high, point_match, low_match, high_match, delta: each recomputed web score beside its published figures.

    scored: model, display_model, case_ref, gold_decision, gold_type, pred_decision, pred_type, strict_report_eligible. mapping: case_ref, ordinal, one to one.
    figures: model (as displayed), metric, point, ci_low, ci_high; models without figures are left out. draws: stream (model), replicate, idx (place by ordinal), times.
    The query fails where a model has another set of cases than the mapping or repeats one, where models differ in gold, and where a row that is not eligible has an answer.
    """
    names = published(scored, figures.select("model").distinct())
    kept = by_ordinal(names, mapping)
    kept = _holds(kept, F.col("strict_report_eligible") | (F.col("pred_decision") == BOTTOM), F.concat(F.lit("an answer that is not eligible: "), F.col("case_ref").cast("string")))
    kept = written(kept.select("model", "display_model", "case_ref", "ordinal", "gold_decision", "gold_type", F.col("pred_decision").alias("web_pred_decision"), F.col("pred_type").alias("web_pred_type")), "web")
    wrong = aligned(kept, key="ordinal", gold=("case_ref", "gold_decision", "gold_type")).where("variants <> 1")
    sizes = kept.groupBy("model").agg(F.count("*").alias("n"), F.min("display_model").alias("display")).join(names.groupBy("model").agg(F.count("*").alias("given")), "model")
    sizes = sizes.crossJoin(F.broadcast(mapping.agg(F.count("*").alias("cases")))).crossJoin(F.broadcast(wrong.agg(F.count("*").alias("wrong"))))  # one row each
    sizes = _holds(sizes, (F.col("n") == F.col("cases")) & (F.col("given") == F.col("n")), F.concat(F.lit("not the cases of the mapping: "), F.col("model")))
    sizes = _holds(sizes, F.col("wrong") == 0, "models differ in gold")
    got = paired_bootstrap(kept, draws, types, order="ordinal", decisions=decisions, prefixes=("web",)).join(sizes.select("model", "display"), "model")
    told = figures.select(F.col("model").alias("display"), "metric", *[F.col(c).alias(f"_{c}") for c in ("point", "ci_low", "ci_high")])
    both = got.join(told, ["display", "metric"], "left")
    gap = lambda c: F.abs(F.col(c) - F.col(f"_{c}"))
    near = lambda c: F.coalesce(gap(c) <= tolerance, F.lit(False))
    return both.select("model", "metric", "point", "ci_low", "ci_high", near("point").alias("point_match"), near("ci_low").alias("low_match"), near("ci_high").alias("high_match"), F.greatest(gap("point"), gap("ci_low"), gap("ci_high")).alias("delta"))


def reproduction_status(compared: DataFrame) -> DataFrame:
    """One row: points and interval ends that match, of how many, the greatest difference, status."""
    n = compared.agg(
        F.count_if("point_match").alias("point_matches"), F.count("*").alias("point_comparisons"), F.coalesce(F.sum(F.col("low_match").cast("int") + F.col("high_match").cast("int")), F.lit(0)).alias("ci_endpoint_matches"),
        (2 * F.count("*")).alias("ci_endpoint_comparisons"), F.max("delta").alias("max_absolute_difference"), F.count_if(F.col("delta") == 0).alias("exact"),
    )
    whole = (F.col("point_matches") == F.col("point_comparisons")) & (F.col("ci_endpoint_matches") == F.col("ci_endpoint_comparisons")) & (F.col("point_comparisons") > 0)
    return n.withColumn("status", F.when(whole, "WEB_ONLY_NUMERIC_MATCH_WITHIN_TOLERANCE").otherwise("PARTIAL_MATCH_SEE_COMPARISON"))
