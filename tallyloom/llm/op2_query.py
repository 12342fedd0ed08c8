"""op2: a verdict for every url of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import table
from tallyloom.llm.url_filter import Rule, judge_urls

RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


# The closure of aliases by repeated least labels; DuckDB ends it when nothing is new.
ORACLE = r"""
WITH RECURSIVE
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*?>')) AS tag FROM pages
  WHERE contains(url, '://') AND (html ILIKE '%canonical%' OR html ILIKE '%http-equiv%')),
targets AS (
  SELECT url, CASE
    WHEN regexp_matches(tag, '(?is)^<link') AND regexp_matches(tag, '(?is)\srel\s*=\s*["'']?[^"''>]*\bcanonical\b')
      THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta') AND regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?refresh\b')
      THEN regexp_extract(tag, '(?is)content\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*[''"]?([^"''\s>]+)', 1)
    ELSE '' END AS link FROM tags),
full_links AS (
  SELECT url, CASE WHEN contains(link, '://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
    ELSE '' END AS link FROM targets WHERE link <> ''),
links AS (
  SELECT DISTINCT
    translate(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS a,
    translate(regexp_extract(link, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(replace(link, '&amp;', '&'), '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b
  FROM full_links WHERE link <> ''),
edges AS (SELECT a, b FROM links WHERE b <> '' AND a <> b UNION SELECT b, a FROM links WHERE b <> '' AND a <> b),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
components AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a),
addressed AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    translate(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS place
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM addressed),
nodes AS (
  SELECT component, regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(node, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM components),
blocked AS (
  SELECT component, bool_or(CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN false
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN true
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN false
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN true ELSE false END) AS blocked FROM nodes GROUP BY component)
SELECT r.page_id, r.host, r.path, r.rule,
  CASE WHEN r.rule IN ('net/', 'example.com/de/') THEN 'block' WHEN r.rule IS NOT NULL THEN 'allow'
       WHEN b.blocked THEN 'block' ELSE 'allow' END AS verdict,
  c.component AS alias_of
FROM ruled r LEFT JOIN components c ON r.place = c.node LEFT JOIN blocked b ON c.component = b.component
"""
