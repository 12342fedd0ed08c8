"""Queries in the record formats, over records made from the given tables: scoring, paired bootstrap, transformation, audit."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyloom.functions.rng import twister_draws
from tallyloom.operators import evidence, scoring, statistics, transform
from tallyloom.plans import fixtures
from tallyloom.plans.registry import query, table
from tallyloom.plans.score_queries import CASES_SQL, MICRO_SQL, TYPES, document_cases, judged_documents

#: Totals of a site's cases, from which all its rates follow.
TOTALS = ("char_edits", "reference_characters", "mixed_token_edits", "reference_mixed_tokens", "exact_message_count", "target_message_count")


@query("q12_mt_bootstrap")
def q12(spark, d):
    """Site-clustered intervals of the scoring report by Mersenne-Twister draws; sites are sources, summed before they are weighed."""
    cases = document_cases(spark, d)
    sums = cases.groupBy("site_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in TOTALS], *[F.count_if(c).alias(c) for c in scoring.RATES.values()])
    total = lambda c: F.sum(F.col(c) * F.col("w"))
    metrics = {name: scoring.ratio(total(c), total("n")) for name, c in scoring.RATES.items()} | {
        "character_error_rate": scoring.ratio(total("char_edits"), total("reference_characters")), "mixed_token_error_rate": scoring.ratio(total("mixed_token_edits"), total("reference_mixed_tokens")),
        "message_exact_rate_per_message": scoring.ratio(total("exact_message_count"), total("target_message_count")),
    }
    sites = table(spark, d, "documents").select("source").distinct().count()
    draws = twister_draws(spark, seeds={"task1": 20260726}, replicates=200, size=sites) if sites else statistics.hash_draws(spark, 0, 1, salt="none")
    return statistics.cluster_bootstrap(sums, draws, metrics, cluster="site_id")


@query("q61_score_report", f"""
WITH {CASES_SQL}, labelled AS (SELECT * FROM cases WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT 'overall' AS scope, NULL AS value, {MICRO_SQL} FROM labelled UNION ALL SELECT 'platform', lang, {MICRO_SQL} FROM labelled GROUP BY lang
UNION ALL SELECT 'obfuscation_type', tag, {MICRO_SQL} FROM (SELECT *, unnest(tags) AS tag FROM labelled) GROUP BY tag""")
def q61(spark, d):
    """The scoring report of the documents that have labels."""
    labelled = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("sample_id")).distinct()
    return scoring.report(document_cases(spark, d).join(labelled, "sample_id", "left_semi"))


@query("q62_paired_bootstrap_mt")
def q62(spark, d):
    rows = judged_documents(spark, d)
    draws = twister_draws(spark, seeds=statistics.model_seeds(rows, 20260727), replicates=100, size=max(rows.where("model = 'm900'").count(), 1))
    return statistics.paired_bootstrap(rows, draws, TYPES)


@query("q63_variant_records")
def q63(spark, d):
    """Variants of all conversations: assistants' turns carry an entry."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("transform"), F.coalesce("text", F.lit("")).alias("text"))
    message = F.struct("turn", F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("message_id"), F.when(F.col("transform"), F.concat("text", F.lit(" {{ENTRY}} then"))).otherwise(F.col("text")).alias("text"), "transform").alias("m"))
    sources = turns.groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]).alias("messages"))
    sources = sources.withColumn("entry", F.concat(F.lit("https://one.test/"), "session_id"))
    recipes = [transform.Recipe(0), transform.Recipe(1, homophones=({"rule_id": "h1", "source": "then", "candidates": ["zen"], "probability": 1.0},), markers=({"rule_id": "k1", "value": "·"},)), transform.Recipe(2, tokens=("[ok]",), columns=3)]
    return transform.expand_variants(sources, recipes, seed="global", stages=False).select("sample_id", "session_id", "variant", "final_messages", "record_sha256")


#: What the audit must say of each of the fixture's bodies, in their order.
VERDICTS = ("SUPPORTED_HIGH_RISK", "INVALID_EVIDENCE", "INVALID_EVIDENCE", "INVALID_EVIDENCE", "INSUFFICIENT_EVIDENCE", "CONFLICTING_EVIDENCE", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE", "INVALID_EVIDENCE")
WARNED = {4: "negative_observation:E2:incomplete_search_scope"}


@query("q50_evidence_audit", f"""
WITH v AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{x}', '{WARNED.get(i, '')}')" for i, x in enumerate(VERDICTS))}) t(kind, outcome, warnings))
SELECT 's' || s_suppkey AS case_id, outcome, warnings FROM supplier JOIN v ON s_suppkey % {len(VERDICTS)} = kind""")
def q50(spark, d):
    """A case for each supplier, by its number in order or broken in one of eight ways."""
    bodies = F.array(*[F.lit(json.dumps(b)) for b in fixtures.broken_cases()])
    rows = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.from_json(F.get(bodies, (F.col("s_suppkey") % len(VERDICTS)).cast("int")), evidence.SCHEMA).alias("c"))
    cases = rows.select("id", "c.*").drop("case_id").withColumnRenamed("id", "case_id")
    return evidence.audit(cases).select("case_id", "outcome", F.array_join("warnings", ",").alias("warnings"))
