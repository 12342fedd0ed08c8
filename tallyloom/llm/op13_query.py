"""op13: documents drawn towards the distribution of the benchmark's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import table
from tallyloom.llm.resampling import Draw, resampled

DRAW = Draw()


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), DRAW)


def _crc_table() -> list[int]:
    """CRC-32 of each byte, without the inversions, by the reversed polynomial."""
    out = list(range(256))
    for _ in range(8):
        out = [(c >> 1) ^ (0xEDB88320 * (c & 1)) for c in out]
    return out


#: DuckDB has no CRC-32: the bytes of hex digits `h` are folded through the table.
CRC32 = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda x, b: xor(x >> 8, ({_crc_table()}::BIGINT[])[(xor(x, b) & 255) + 1])), 4294967295::BIGINT)"""
ORACLE = f"""
WITH texts AS (
  SELECT 0 AS kind, row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
worded AS (SELECT kind, id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
runs AS (
  SELECT kind, id, unnest(w) AS f FROM worded
  UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded WHERE len(w) > 1),
held AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)),
hashed AS (
  SELECT f, {CRC32} % {DRAW.buckets} AS bucket FROM held),
counted AS (SELECT kind, id, bucket, count(*) AS n FROM runs JOIN hashed USING (f) GROUP BY ALL),
sums AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t
  FROM range({DRAW.buckets}) b(bucket) LEFT JOIN counted c ON c.bucket = b.bucket GROUP BY ALL),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {DRAW.buckets}) / ((s + 1) * (sum(t) OVER () + {DRAW.buckets}))))::BIGINT AS gain FROM sums),
weights AS (SELECT id, sum(n) AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM counted JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{DRAW.seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (id) WHERE kind = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {DRAW.min_words} ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= {DRAW.min_words} AND place <= {DRAW.percent} * (SELECT count(*) FROM scored WHERE n_words >= {DRAW.min_words}) // 100 THEN place END AS rank
FROM placed
"""
