"""Text, hash, transformation and scanning queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from tallyloom.functions import rng, text
from tallyloom.functions.safety import safety_findings, safety_normalised
from tallyloom.operators import dictionary, rules, transform
from tallyloom.operators.scoring import confusable_legend
from tallyloom.plans.registry import query, table


@query("q25_explode_tags", """
WITH t AS (SELECT doc_id, n_chars, list_filter([CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END, CASE WHEN contains(text, '!!') THEN 'shout' END, CASE WHEN n_chars < 500 THEN 'short' END], lambda x: x IS NOT NULL) AS tags FROM documents)
SELECT tag, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM (SELECT unnest(tags) AS tag, n_chars FROM t) GROUP BY tag""")
def q25(spark, d):
    tag = lambda c, n: F.when(c, n)
    tags = F.array_compact(F.array(tag(F.col("text").contains("|"), "table"), tag(F.col("text").rlike("[0-9]"), "digits"), tag(F.col("text").contains("!!"), "shout"), tag(F.col("n_chars") < 500, "short")))
    return table(spark, d, "documents").select("n_chars", F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("q26_token_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[㐀-鿿]|[A-Za-z0-9]+|[^\s\p{Z}]'))::INT AS tokens FROM documents")
def q26(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.mixed_tokens(F.col("text"))).alias("tokens"))


# what is left out is the distance, since the answer is a part of the reference in order
@query("q27_token_edit", r"""
WITH t AS (SELECT item_id, regexp_extract_all(text, '[㐀-鿿]|[A-Za-z0-9]+|[^\s\p{Z}]') AS a FROM benchmark)
SELECT item_id, CAST(len(list_filter(range(len(a)), lambda i: i % 7 = 3)) AS INTEGER) AS edits, CAST(len(a) AS INTEGER) AS reference_tokens FROM t""")
def q27(spark, d):
    b = table(spark, d, "benchmark").select("item_id", text.mixed_tokens(F.col("text")).alias("a"))
    b = b.withColumn("b", F.filter("a", lambda t, i: i % 7 != 3))
    return b.select("item_id", text.token_edits("a", "b").alias("edits"), F.size("a").alias("reference_tokens"))


@query("q28_normalize", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \t\r\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^[\s]+|[\s]+$', '', 'g')) AS digest FROM documents""")
def q28(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.normal_text(F.col("text")), 256).alias("digest"))


URL_SQL = {
    "scheme": r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))", "host": r"lower(regexp_extract(url, '^[^:/?#]+://(?:[^@/?#]*@)?([^:/?#]*)', 1))", "port": r"regexp_extract(url, '^[^:/?#]+://[^/?#:]*:([0-9]+)', 1)",
    "path": r"regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)", "query": r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)", "fragment": r"regexp_extract(url, '#(.*)$', 1)",
}


@query("q29_url_parts", f"""
WITH p AS (SELECT page_id, {', '.join(f'{s} AS {k}' for k, s in URL_SQL.items())} FROM pages)
SELECT *, host IN ('localhost', 'example.com', 'example.net', 'example.org') OR ends_with(host, '.test') OR ends_with(host, '.invalid') OR ends_with(host, '.example') OR ends_with(host, '.localhost')
  OR ends_with(host, '.example.com') OR ends_with(host, '.example.net') OR ends_with(host, '.example.org') AS reserved FROM p""")
def q29(spark, d):
    p = table(spark, d, "pages").select("page_id", *[c.alias(k) for k, c in text.url_parts(F.col("url")).items()])
    return p.withColumn("reserved", text.reserved_host_column(F.col("host")))


@query("q30_entry_canonical", f"""
WITH p AS (SELECT page_id, {', '.join(f'{s} AS {k}' for k, s in URL_SQL.items())} FROM pages)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END || CASE WHEN fragment = '' THEN '' ELSE '#' || fragment END AS canonical FROM p""")
def q30(spark, d):
    return table(spark, d, "pages").select("page_id", text.entry_parts("url").getField("canonical").alias("canonical"))


@query("q31_redact", r"""
WITH a AS (SELECT lang, trim(regexp_replace(text, '[\s\p{Z}\x{85}]+', ' ', 'g')) AS t FROM documents),
b AS (SELECT lang, regexp_replace(t, '(?i)\b(?:https?://|www\.)\S+', '[MASKED_URL]', 'g') AS t FROM a),
c AS (SELECT lang, regexp_replace(t, '(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|net|org|cn|io|app|top|xyz|info|me|co|in|cc|test|blog|online)\b', '[MASKED_DOMAIN]', 'g') AS t FROM b),
d AS (SELECT lang, regexp_replace(t, '(^|[^0-9])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})($|[^0-9])', '\1[MASKED_IP]\2', 'g') AS t FROM c),
r AS (SELECT lang, regexp_replace(t, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[MASKED_EMAIL]', 'g') AS t FROM d)
SELECT lang, sum(len(regexp_extract_all(t, 'MASKED_URL')))::BIGINT AS urls, sum(len(regexp_extract_all(t, 'MASKED_EMAIL')))::BIGINT AS emails, sum(len(regexp_extract_all(t, 'MASKED_DOMAIN')))::BIGINT AS domains,
  sum(len(regexp_extract_all(t, 'MASKED_IP')))::BIGINT AS ips, sum(length(t))::BIGINT AS chars, sum(length(substr(t, 1, 180)))::BIGINT AS shown FROM r GROUP BY lang""")
def q31(spark, d):
    r = table(spark, d, "documents").select("lang", text.redacted(F.col("text"), None, apart=True).alias("t"), text.redacted(F.col("text"), apart=True).alias("s"))
    n = lambda m: F.sum(F.regexp_count("t", F.lit(f"MASKED_{m}")))
    return r.groupBy("lang").agg(n("URL").alias("urls"), n("EMAIL").alias("emails"), n("DOMAIN").alias("domains"), n("IP").alias("ips"), F.sum(F.length("t")).alias("chars"), F.sum(F.length("s")).alias("shown"))


@query("q32_safety_scan")
def q32(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(safety_findings("text")).alias("f"))
    return found.groupBy("f.kind").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("docs"))


@query("q33_secret_scan", f"SELECT lang, {', '.join(f'''sum(len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')))::BIGINT AS {k}''' for k, p in rules.SECRETS.items())} FROM documents GROUP BY lang")
def q33(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(*[F.sum(c).alias(k) for k, c in rules.secret_counts(F.col("text")).items()])


@query("q34_sha_manifest", """
WITH b AS (SELECT source, substr(sha256(text), 1, 2) AS bucket, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes, sha256(string_agg(sha256(text), chr(10) ORDER BY sha256(text)) || chr(10)) AS digest FROM documents GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS files, sum(bytes)::BIGINT AS total_bytes, sha256(string_agg(bucket || digest, chr(10) ORDER BY bucket) || chr(10)) AS manifest_digest FROM b GROUP BY source""")
def q34(spark, d):
    """A digest of digests of 256 parts, so that a large source is no single list."""
    docs = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("b"))
    parts = docs.groupBy("source", F.substring("h", 1, 2).alias("k")).agg(F.count("*").alias("n"), F.sum("b").alias("b"), text.ids_digest(F.collect_list("h")).alias("d"))
    return parts.groupBy("source").agg(F.sum("n").alias("files"), F.sum("b").alias("total_bytes"), text.ids_digest(F.collect_list(F.concat("k", "d"))).alias("manifest_digest"))


@query("q35_canonical_json", """
SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"key":' || o_orderkey || ',"open":' || (o_orderstatus = 'O') || ',"priority":"' || o_orderpriority || '"}') AS record_sha256 FROM orders""")
def q35(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.self_hash(priority=F.col("o_orderpriority"), key=F.col("o_orderkey"), customer=F.col("o_custkey"), open=F.col("o_orderstatus") == "O").alias("record_sha256"))


@query("q36_hash_rng", f"""
WITH d AS (SELECT p_partkey, i, ('0x' || substr(sha256(unhex(sha256('global|' || p_partkey)) || unhex(printf('%016x', i))), 1, 16))::UBIGINT AS draw FROM part, range(3) t(i))
SELECT p_partkey, i, draw::VARCHAR AS draw, (draw % 7)::BIGINT AS below7, draw < {rng.threshold(0.72)}::UBIGINT AS happens FROM d""")
def q36(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("i"))
    p = p.withColumn("u", rng.u64(rng.seed_hex(F.concat(F.lit("global|"), F.col("p_partkey").cast("string"))), F.col("i")))
    return p.select("p_partkey", "i", F.col("u").cast("string").alias("draw"), rng.below(F.col("u"), 7).alias("below7"), rng.happens(F.col("u"), 0.72).alias("happens"))


@query("q37_variant_expand", """
WITH r AS (SELECT * FROM (VALUES (0, NULL, NULL), (1, 5, NULL), (2, NULL, 'wide'), (3, 9, 'narrow'), (4, 1, 'wide'), (5, 2, NULL)) t(variant, size, style))
SELECT p_partkey || '--v' || lpad(variant::VARCHAR, 3, '0') AS sample_id, variant, coalesce(size, p_size) AS size, coalesce(style, p_type) AS style FROM part, r""")
def q37(spark, d):
    recipes = spark.createDataFrame([(0, None, None), (1, 5, None), (2, None, "wide"), (3, 9, "narrow"), (4, 1, "wide"), (5, 2, None)], "variant int, size int, style string")
    x = table(spark, d, "part").crossJoin(F.broadcast(recipes))  # six recipes
    got = transform.override_columns({"size": F.col("p_size"), "style": F.col("p_type")}, {"size": F.col("size"), "style": F.col("style")})
    return x.select(F.concat(F.col("p_partkey").cast("string"), F.lit("--v"), F.lpad(F.col("variant").cast("string"), 3, "0")).alias("sample_id"), "variant", *[c.alias(k) for k, c in got.items()])


MAPPING = [("A", "Α"), ("A", "А"), ("O", "Ο"), ("I", "Ι"), ("N", "Ν"), ("_", "＿"), ("0", "０")]


@query("q38_char_map_substitute", f"""
WITH m AS (SELECT * FROM (VALUES {', '.join(str(x) for x in MAPPING)}) t(character, target)),
c AS (SELECT n_nationkey, unnest(string_split(n_name, '')) AS ch, generate_subscripts(string_split(n_name, ''), 1) AS i FROM nation),
f AS (SELECT n_nationkey, ch AS character, row_number() OVER (PARTITION BY n_nationkey ORDER BY min(i)) - 1 AS position FROM c GROUP BY n_nationkey, ch)
SELECT n_nationkey, position::INT AS position, character, list_sort(list(target)) AS targets FROM f JOIN m USING (character) GROUP BY ALL""")
def q38(spark, d):
    mapping = spark.createDataFrame(MAPPING, "character string, target string")
    return confusable_legend(table(spark, d, "nation"), mapping, key="n_nationkey", text="n_name")


@query("q39_grid_layout", """
WITH u AS (SELECT n_nationkey, n_name, string_split(n_name, '') AS c FROM nation)
SELECT n_nationkey, list_transform(range(3), lambda r: array_to_string(list_filter(list_transform(range(0, 8), lambda k: c[(k * 3 + r + 1)::INT]), lambda x: x IS NOT NULL), '')) AS grid, n_name AS inverse FROM u""")
def q39(spark, d):
    units = F.split("n_name", "")
    row = lambda r: F.array_join(F.filter(units, lambda x, i: i % 3 == r), "")
    n = table(spark, d, "nation").select("n_nationkey", F.transform(F.sequence(F.lit(0), F.lit(2)), row).alias("grid"), F.length("n_name").alias("_n"))
    back = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring(F.get("grid", (i % 3).cast("int")), (F.floor(i / 3) + 1).cast("int"), F.lit(1))), "")
    return n.select("n_nationkey", "grid", back.alias("inverse"))


LEXICON = [{"rule_id": "r1", "source": "the", "candidates": ["teh", "da"], "probability": 0.7}, {"rule_id": "r2", "source": "then", "candidates": ["zen"], "probability": 0.9}, {"rule_id": "r3", "source": "an", "candidates": ["ann", "an"], "probability": 0.5}]


@query("q40_edit_invert")
def q40(spark, d):
    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for i, t in zip(b["item_id"], b["text"]):
                edits = transform.lexicon_edits(t or "", LEXICON, rng.Stream(f"q40|{i}"))
                new, placed = transform.apply_edits(t or "", edits)
                out.append((i, len(edits), transform.invert_edits(new, placed) == (t or "")))
            yield pd.DataFrame(out, columns=["item_id", "edits", "restored"])

    return table(spark, d, "benchmark").mapInPandas(run, "item_id long, edits int, restored boolean")


@query("q41_longest_match", "SELECT item_id, len(regexp_extract_all(text, 'then|the|an'))::INT AS matches, len(list_filter(regexp_extract_all(text, 'then|the|an'), lambda x: x = 'then'))::INT AS longest FROM benchmark")
def q41(spark, d):
    from tallyloom.operators.integrity import longest_prefix_join

    m = longest_prefix_join(table(spark, d, "benchmark"), [(r["rule_id"], r["source"]) for r in LEXICON], "text")
    return table(spark, d, "benchmark").select("item_id", F.size(m).alias("matches"), F.size(F.filter(m, lambda x: x == "then")).alias("longest"))


def word_entries(spark, d):
    """A dictionary table from the benchmark's texts: each different word of five letters or more, to be written between marks; the short words of these are shorter sources."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("source")).where("length(source) >= 5").distinct()
    words = words.unionAll(words.select(F.substring("source", 1, 4))).distinct()
    return words.select(F.concat(F.lit("w:"), "source").alias("rule_id"), "source", F.array(F.concat(F.lit("<"), "source", F.lit(">"))).alias("candidates"), F.lit(1.0).alias("probability"))


@query("q67_dictionary_rewrite", """
WITH words AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark), five AS (SELECT w FROM words WHERE len(w) >= 5),
sources AS (SELECT DISTINCT w FROM (FROM five UNION ALL SELECT substr(w, 1, 4) FROM five)),
pattern AS (SELECT string_agg(w, '|' ORDER BY len(w) DESC, w) AS p FROM sources),
named AS (SELECT user_id, event_id, 'xx' || (SELECT text FROM benchmark WHERE item_id = event_id % (SELECT count(*) FROM benchmark)) || '{{ENTRY}}' || event_type || 'Thatble' AS t FROM events),
found AS (SELECT DISTINCT t, replace(t, '{{ENTRY}}', chr(1)) AS u, (SELECT p FROM pattern) AS p FROM named),
done AS (SELECT t, len(regexp_extract_all(u, p))::BIGINT AS matches, list_max(list_transform(regexp_extract_all(u, p), lambda x: len(x)))::INT AS longest,
  md5(replace(regexp_replace(u, '(' || p || ')', '<\\1>', 'g'), chr(1), '{{ENTRY}}')) AS rewritten FROM found)
SELECT event_id, matches, longest, rewritten FROM named JOIN done USING (t)""")
def q67(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("_i"), F.col("text").alias("_t"))
    n = items.agg(F.count("*").alias("_n"))
    named = table(spark, d, "events").crossJoin(F.broadcast(n)).join(items, F.col("event_id") % F.col("_n") == F.col("_i"))  # one row
    named = named.select("event_id", F.concat(F.lit("xx"), "_t", F.lit("{{ENTRY}}"), "event_type", F.lit("Thatble")).alias("t"))
    got = dictionary.dictionary_rewrites(named, word_entries(spark, d), "event_id", "t", seed="q67")
    return got.select("event_id", F.size("edits").cast("long").alias("matches"), F.array_max(F.transform("edits", lambda e: e["end"] - e["start"])).alias("longest"), F.md5("t").alias("rewritten"))


@query("q48_forbidden_keys", """SELECT event_type, count(*) FILTER (WHERE list_contains(json_keys(props), 'k')) AS with_k, count(*) FILTER (WHERE list_contains(json_keys(props), 'gold')) AS with_gold FROM events GROUP BY event_type""")
def q48(spark, d):
    keys = rules.forbidden_json_keys(F.col("props"), ["k", "gold"])
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.array_contains(keys, "k")).alias("with_k"), F.count_if(F.array_contains(keys, "gold")).alias("with_gold"))


@query("q53_safety_normalise")
def q53(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(safety_normalised("text"), 256).alias("digest"))


@query("q54_model_json", r"""
WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN 'answer: ' || props || ' done' ELSE 'none' END AS content FROM events)
SELECT event_id, CAST(json_extract(regexp_extract(content, '(?s)(\{.*\})', 1), '$.k') AS BIGINT) AS k FROM t WHERE contains(content, '{')""")
def q54(spark, d):
    c = F.expr("CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat('answer: ', props, ' done') ELSE 'none' END")
    got = table(spark, d, "events").select("event_id", text.json_object(c).alias("j")).where("j IS NOT NULL")
    return got.select("event_id", F.get_json_object("j", "$.k").cast("bigint").alias("k"))


@query("q55_slug", "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(p_name || ' / ' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'model') AS slug FROM part")
def q55(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))
