"""op11: the prefix trie of conversations that are rebuilt so as to share their beginnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import Written, table
from tallyloom.llm.op13_query import CRC32
from tallyloom.llm.prefix_trie import prefix_trie, turn_places

#: Conversations of a group begin alike; at most HEADS - 1 turns are shared.
GROUP, HEADS = 5, 9


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, convs): each conversation c begins with the first h turns of conversation c - c % GROUP and goes on with its own after its first h, h being crc32(c) % HEADS."""
    convs = Written(placed.groupBy("conv").agg(F.max("place").alias("n")), "convs").df
    convs = convs.select("conv", "n", (F.col("conv") - F.col("conv") % GROUP).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h"))
    lent = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    shift = convs.join(lent, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    own = placed.join(shift, "conv").where("place > h").select("conv", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "turn_key", "n_bytes")
    heads = placed.where(F.col("place") < HEADS).withColumnRenamed("conv", "base").join(shift, "base").where("place <= h").select("conv", "place", "turn_key", "n_bytes")
    return own.unionByName(heads), convs.select("conv")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = Written(turn_places(table(spark, sf_dir, "conversations")), "places")
    return prefix_trie(*rebuilt(placed.df)).drop("position", "subtree_end")


ORACLE = f"""
WITH keyed AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS turn_key, strlen(coalesce(text, '')) AS n_bytes
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, turn_key, n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, turn_key) AS place FROM keyed),
sizes AS (SELECT conv_id, count(*) AS n, hex(encode(conv_id::VARCHAR)) AS h FROM keyed GROUP BY conv_id),
shift AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken
  FROM (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {CRC32} % {HEADS} AS h FROM sizes) c LEFT JOIN sizes b ON b.conv_id = c.base),
rebuilt AS (
  SELECT s.conv_id, s.taken + p.place - s.h AS depth, turn_key, n_bytes FROM placed p JOIN shift s USING (conv_id) WHERE place > h
  UNION ALL SELECT s.conv_id, place, turn_key, n_bytes FROM placed p JOIN shift s ON p.conv_id = s.base AND place <= h),
paths AS (
  SELECT conv_id, 0 AS depth, '' AS path, NULL AS parent, 0 AS n_bytes FROM sizes
  UNION ALL SELECT conv_id, depth, sha256(keys), CASE WHEN depth = 1 THEN '' ELSE sha256(substr(keys, 1, length(keys) - 32)) END, n_bytes
  FROM (SELECT *, string_agg(turn_key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS keys FROM rebuilt)),
held AS (SELECT depth, path, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n_bytes) AS saved FROM paths GROUP BY depth, path),
nodes AS (SELECT h.*, coalesce(c.n_children, 0) AS n_children FROM held h LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM held WHERE depth > 0 GROUP BY ALL) c ON c.parent = h.path AND c.depth = h.depth),
below AS (
  SELECT a.depth, a.path, sum(v.saved) AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves
  FROM nodes v JOIN paths a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.depth, a.path),
lasts AS (SELECT conv_id, max(depth) AS depth, arg_max(path, depth) AS path FROM paths GROUP BY conv_id),
ends AS (SELECT depth, path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM lasts GROUP BY depth, path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN below USING (depth, path) LEFT JOIN ends USING (depth, path) LEFT JOIN nodes p ON p.path = n.parent AND p.depth = n.depth - 1
"""
