"""op1: the drawn documents with their calibrated probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import table
from tallyloom.llm.mixing import Mixture, mixed

MIX = Mixture()
#: Sweeps in SQL, which has no loop that ends when the cells settle; more than enough for these tables.
SWEEPS = 16


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixed(table(spark, sf_dir, "documents"), MIX)
    return got.select("doc_id", "source", "lang", F.col("_mix.topic").alias("topic"), F.col("_mix.n_tokens").alias("n_tokens"), F.round("_mix.probability", 6).alias("probability"))


def _oracle(mix: Mixture) -> str:
    topic = "CASE WHEN regexp_matches(t, '(?i)\\blicensed? under\\b|\\bcopyright\\b') THEN 'licence' WHEN contains(t, '|') THEN 'table' WHEN regexp_matches(t, '[0-9]') THEN 'numeric' ELSE 'prose' END"
    steps, at = [], "shares"
    for n in range(SWEEPS):
        for key in ("source", "lang", "topic"):
            steps.append(f"s{n}_{key} AS (SELECT * REPLACE (w * share_{key} * total / sum(w) OVER (PARTITION BY {key}) AS w) FROM {at})")
            at = f"s{n}_{key}"
    shares = ", ".join(f"share_{k} AS (SELECT {k}, pow(sum(tokens)::DOUBLE, {mix.power}) / sum(pow(sum(tokens)::DOUBLE, {mix.power})) OVER () AS share_{k} FROM held GROUP BY {k})" for k in ("source", "lang", "topic"))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
described AS (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(t, '[^ \\t\\n\\r\\f\\v]+'))::BIGINT AS n_tokens FROM texts),
held AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM described GROUP BY ALL HAVING sum(n_tokens) > 0),
{shares},
shares AS (SELECT h.*, share_source, share_lang, share_topic, tokens::DOUBLE AS w, (SELECT sum(tokens) FROM held)::DOUBLE AS total
  FROM held h JOIN share_source USING (source) JOIN share_lang USING (lang) JOIN share_topic USING (topic)),
{", ".join(steps)},
weighted AS (SELECT source, lang, topic, tokens, w, total, w / tokens AS weight FROM {at}),
scaled AS (SELECT *, ({mix.budget} * total - coalesce(sum(tokens) OVER before, 0)) / sum(w) OVER after AS c, row_number() OVER (ORDER BY weight DESC, source, lang, topic) AS n FROM weighted
  WINDOW before AS (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
probs AS (SELECT source, lang, topic, least(1.0, weight * (SELECT coalesce(arg_min(c, n), 1.0) FROM scaled WHERE c * weight <= 1.0)) AS probability FROM weighted)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(coalesce(p.probability, 1.0), 6) AS probability
FROM described d LEFT JOIN probs p USING (source, lang, topic)
WHERE ('0x' || substr(sha256('{mix.seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < coalesce(p.probability, 1.0)
"""


ORACLE = _oracle(MIX)
