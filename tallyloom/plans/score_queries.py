"""Scoring, resampling and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators.ranking import top_k_flags
from tallyloom.operators.scoring import apply_gate, id_differences, micro_averages, report, score_cases, with_default_predictions
from tallyloom.operators.statistics import DECISIONS, bootstrap_by_patterns, cluster_bootstrap, decision_scores, exact_percentiles, hash_draws, macro_f1, metric_rows, paired_scores, percentile_nearest, within_tolerance
from tallyloom.plans.registry import query, table

#: Cases are documents, messages are the clauses of a text; the answer replaces e by 3 in every third document, and every seventh has none.
CLAUSE_END = "[.,!?|\\n]+"
TAGS_SQL = "list_filter([CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END, CASE WHEN contains(text, '!!') THEN 'shout' END, CASE WHEN n_chars < 500 THEN 'short' END], lambda x: x IS NOT NULL)"
NORMAL_SQL = r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(part), '[ \t\r\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^[\s]+|[\s]+$', '', 'g')"
# an answer without e in it is as many edits away as characters, or tokens, with an e are in the reference: the bytes that levenshtein compares are as many
CASES_SQL = rf"""parts AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '{CLAUSE_END}')) AS part FROM documents),
golden AS (SELECT doc_id, {NORMAL_SQL} AS gold FROM parts),
answered AS (SELECT doc_id, gold, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN replace(gold, 'e', '3') ELSE gold END AS answer, regexp_extract_all(gold, '[㐀-鿿]|[A-Za-z0-9]+|[^\s\p{{Z}}]') AS tokens FROM golden),
edited AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gold = answer) AS x, sum(length(gold)) AS c, sum(len(tokens)) AS t, sum(CASE WHEN doc_id % 7 = 0 THEN length(gold) ELSE levenshtein(gold, answer) END) AS e,
  sum(CASE WHEN doc_id % 7 = 0 THEN len(tokens) WHEN doc_id % 3 = 0 THEN len(list_filter(tokens, lambda y: contains(y, 'e'))) ELSE 0 END) AS te FROM answered GROUP BY doc_id),
said AS (SELECT doc_id, lang, source, {TAGS_SQL} AS tags, doc_id % 7 = 0 AS missing FROM documents),
judged AS (SELECT *, missing OR doc_id % 11 = 0 AS abstain, NOT missing AND doc_id % 4 <> 0 AS intent, NOT missing AND doc_id % 9 <> 0 AS platform, NOT missing AND doc_id % 5 <> 0 AS top1, NOT missing AND (doc_id % 5 <> 0 OR doc_id % 10 = 0) AS topk,
  CASE WHEN missing THEN 0 ELSE (doc_id % 5 = 0)::INT + (doc_id % 10 <> 0)::INT END AS live FROM said),
cases AS (SELECT *, n = x AS every FROM judged JOIN edited USING (doc_id))"""


def _rate_sql(condition):
    return f"coalesce(sum(({condition})::INT) / nullif(count(*), 0), 0.0)"


MICRO_SQL = f"""count(*) AS case_count, coalesce(sum(n), 0)::BIGINT AS target_message_count, coalesce(sum(e) / nullif(sum(c), 0), 0.0) AS character_error_rate, coalesce(sum(te) / nullif(sum(t), 0), 0.0) AS mixed_token_error_rate,
  coalesce(sum(x) / nullif(sum(n), 0), 0.0) AS message_exact_rate_per_message, {_rate_sql('every')} AS message_exact_rate, {_rate_sql('intent')} AS intent_accuracy, {_rate_sql('platform')} AS platform_accuracy,
  {_rate_sql('top1')} AS entry_top1_exact_rate, {_rate_sql('topk')} AS entry_topk_recall, {_rate_sql('topk')} AS local_resolution_success_rate_at_k, {_rate_sql('abstain')} AS abstain_rate,
  {_rate_sql('every AND intent AND platform AND topk')} AS full_reconstruction_success_rate, {_rate_sql('every AND intent AND platform AND top1')} AS full_reconstruction_success_rate_top1, coalesce(sum(live), 0)::BIGINT AS predicted_live_entry_count"""


def document_tags():
    one = lambda condition, name: F.when(condition, name)
    return F.array_compact(F.array(one(F.col("text").contains("|"), "table"), one(F.col("text").rlike("[0-9]"), "digits"), one(F.col("text").contains("!!"), "shout"), one(F.col("n_chars") < 500, "short")))


def document_cases(spark, d):
    """Scored cases of whole documents."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select(n.cast("string").alias("sample_id"), "doc_id", "source", "lang", document_tags().alias("tags"), "text")
    docs = docs.repartition("sample_id").sortWithinPartitions("sample_id")  # as the join of answers needs it; whole texts travel and are sorted, clauses with their ids take twice the room
    messages = lambda text: F.transform(F.split(F.coalesce(text, F.lit("")), CLAUSE_END), lambda x, i: F.struct(i.cast("string").alias("message_id"), x.alias("text")))
    entry = lambda start: F.concat(F.lit(start), n.cast("string"))
    site = "https://site.test/d?id="
    gold = docs.select("sample_id", F.col("source").alias("site_id"), F.col("lang").alias("platform"), F.lit("Buy Now").alias("intent"), entry(site).alias("entry_value"), F.col("tags").alias("obfuscation_types"), messages(F.col("text")).alias("messages"))
    right, wrong = entry("HTTPS://Site.Test/d?id="), F.lit("https://wrong.org/")
    ranks = F.array(
        F.struct(F.lit(1).alias("rank"), F.when(n % 5 == 0, wrong).otherwise(right).alias("value"), F.lit(0.9).alias("confidence")),
        F.struct(F.lit(2).alias("rank"), F.when(n % 10 == 0, right).otherwise(wrong).alias("value"), F.lit(0.1).alias("confidence")),
    )
    predictions = docs.where("doc_id % 7 <> 0").select(
        "sample_id", F.lit("text").alias("input_view"), F.when(n % 9 == 0, "other").otherwise(F.col("lang")).alias("platform"), F.when(n % 4 == 0, "sell").otherwise("buy  now").alias("intent"), (n % 11 == 0).alias("abstain"),
        messages(F.when(n % 3 == 0, F.replace("text", F.lit("e"), F.lit("3"))).otherwise(F.col("text"))).alias("messages"), ranks.alias("candidates"),
    )
    return score_cases(gold, predictions)


@query("q01_cer_by_lang", f"WITH {CASES_SQL} SELECT lang, {MICRO_SQL} FROM cases GROUP BY lang")
def q01(spark, d):
    return document_cases(spark, d).groupBy(F.col("platform").alias("lang")).agg(*micro_averages())


@query("q02_score_grouping_sets", f"""
WITH {CASES_SQL} SELECT 'overall' AS scope, NULL AS value, {MICRO_SQL} FROM cases UNION ALL SELECT 'platform', lang, {MICRO_SQL} FROM cases GROUP BY lang
UNION ALL SELECT 'obfuscation_type', tag, {MICRO_SQL} FROM (SELECT *, unnest(tags) AS tag FROM cases) GROUP BY tag""")
def q02(spark, d):
    return report(document_cases(spark, d))


@query("q03_missing_prediction_default", """
SELECT d.lang, count(*) AS cases, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing,
  avg(coalesce((l.quality = 1)::INT, 0)) AS success_rate, avg((l.doc_id IS NULL OR l.toxic = 1)::INT) AS abstain_rate
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""")
def q03(spark, d):
    gold = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("platform"))
    none = F.lit(None)
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), none.alias("input_view"), none.alias("platform"), F.col("quality").cast("string").alias("intent"), (F.col("toxic") == 1).alias("abstain"), none.alias("messages"), none.alias("candidates"))
    j = with_default_predictions(gold, labels)
    return j.groupBy(F.col("platform").alias("lang")).agg(F.count("*").alias("cases"), F.count_if("prediction_missing").alias("missing"), F.avg((F.col("p_intent") == "1").cast("int")).alias("success_rate"), F.avg(F.col("p_abstain").cast("int")).alias("abstain_rate"))


@query("q04_unknown_missing_ids", """
WITH given AS (SELECT doc_id FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id FROM labels WHERE doc_id % 10 = 0), gold AS (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0),
odd AS (SELECT 'missing' AS kind, doc_id FROM gold WHERE doc_id NOT IN (SELECT doc_id FROM given) UNION ALL SELECT DISTINCT 'unknown', doc_id FROM given WHERE doc_id NOT IN (SELECT doc_id FROM gold)
  UNION ALL SELECT 'duplicate', doc_id FROM given GROUP BY doc_id HAVING count(*) > 1)
SELECT kind, count(*) AS n, array_to_string(list_sort(list(doc_id))[:10], ',') AS first_ids FROM odd GROUP BY kind""")
def q04(spark, d):
    labels, gold = table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").select("doc_id").where("doc_id % 4 <> 0")
    got = id_differences(gold, labels.where("doc_id % 2 = 0").unionAll(labels.where("doc_id % 10 = 0")), "doc_id")
    return got.select("kind", "n", F.array_join(F.col("first_ids").cast("array<string>"), ",").alias("first_ids"))


def _f1_sql(label, gold="gold", pred="pred"):
    tp, fp, fn = (f"count(*) FILTER (WHERE {a} AND {b})" for a, b in ((f"{gold} = {label}", f"{pred} = {label}"), (f"{gold} <> {label}", f"{pred} = {label}"), (f"{gold} = {label}", f"{pred} <> {label}")))
    p, r = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0.0)", f"coalesce({tp} / nullif({tp} + {fn}, 0), 0.0)"
    return f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0)"


@query("q05_macro_f1", f"""
WITH j AS (SELECT source, quality AS gold, CASE WHEN n_chars > 900 THEN 1 ELSE 0 END AS pred FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) AS n, round(({_f1_sql(0)} + {_f1_sql(1)} + {_f1_sql(2)}) / 3, 12) AS macro_f1 FROM j GROUP BY source""")
def q05(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", F.col("quality").alias("gold"), F.when(F.col("n_chars") > 900, 1).otherwise(0).alias("pred"))
    return j.groupBy("source").agg(F.count("*").alias("n"), F.round(macro_f1(F.col("gold"), F.col("pred"), (0, 1, 2)), 12).alias("macro_f1"))


#: Decisions of labelled documents, from the page and behind a gate; types are languages.
TYPES = ("en", "fr", "de")
DECIDED_SQL = """decided AS (SELECT source, lang, toxic = 0 AS gate, ['VIOLATION', 'NON_VIOLATION', 'INSUFFICIENT_EVIDENCE'][quality + 1] AS gold_d, lang AS gold_t, CASE WHEN n_chars > 900 THEN 'NON_VIOLATION' ELSE 'VIOLATION' END AS web_d,
  CASE WHEN n_chars % 2 = 0 THEN lang ELSE 'other' END AS web_t FROM documents JOIN labels USING (doc_id)),
gated AS (SELECT *, CASE WHEN gate THEN web_d ELSE '__BOTTOM__' END AS gated_d, CASE WHEN gate THEN web_t ELSE '__BOTTOM__' END AS gated_t FROM decided),
typed AS (SELECT *, CASE WHEN gold_d = 'VIOLATION' THEN gold_t END AS gold_v, CASE WHEN gold_d = 'VIOLATION' THEN CASE WHEN web_d = 'VIOLATION' THEN web_t ELSE '__BOTTOM__' END END AS web_v,
  CASE WHEN gold_d = 'VIOLATION' THEN CASE WHEN gated_d = 'VIOLATION' THEN gated_t ELSE '__BOTTOM__' END END AS gated_v FROM gated)"""


def _macro_sql(labels, gold, pred):
    return f"round(({' + '.join(_f1_sql(repr(x), gold, pred) for x in labels)}) / {len(labels)}, 12)"


def _decision_sql(p):
    return f"""round(avg((gold_d = {p}_d)::INT), 12) AS {p}_decision_accuracy, {_macro_sql(DECISIONS, 'gold_d', f'{p}_d')} AS {p}_decision_macro_f1, {_macro_sql(TYPES, 'gold_v', f'{p}_v')} AS {p}_violation_type_macro_f1,
  round(avg((gold_d = {p}_d AND gold_t = {p}_t)::INT), 12) AS {p}_hierarchical_exact_match"""


def decided_documents(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    j = j.select(
        "source", "lang", (F.col("toxic") == 0).alias("gate_pass"), F.get(F.array(*map(F.lit, DECISIONS)), F.col("quality")).alias("gold_decision"), F.col("lang").alias("gold_type"),
        F.when(F.col("n_chars") > 900, DECISIONS[1]).otherwise(DECISIONS[0]).alias("web_pred_decision"), F.when(F.col("n_chars") % 2 == 0, F.col("lang")).otherwise("other").alias("web_pred_type"),
    )
    decision, kind = apply_gate(F.col("web_pred_decision"), F.col("web_pred_type"), F.col("gate_pass"))
    return j.withColumns({"gated_pred_decision": decision, "gated_pred_type": kind})


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 12).alias(c) for c in df.columns if c not in keys])


@query("q06_gate_loss", f"""
WITH {DECIDED_SQL} SELECT source, round(avg(gate::INT), 12) AS entry_gate_pass, {_decision_sql('web')}, {_decision_sql('gated')},
  round(avg((gold_d = web_d)::INT) - avg((gold_d = gated_d)::INT), 12) AS gate_loss FROM typed GROUP BY source""")
def q06(spark, d):
    return _rounded(decided_documents(spark, d).groupBy("source").agg(*paired_scores(TYPES)), "source")


@query("q07_hier_exact", f"WITH {DECIDED_SQL} SELECT lang, {_decision_sql('web')} FROM typed GROUP BY lang")
def q07(spark, d):
    return _rounded(decided_documents(spark, d).groupBy("lang").agg(*[c.alias(k) for k, c in decision_scores("web", TYPES).items()]), "lang")


@query("q08_percentile_linear", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS p025, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.975), 6) AS p975 FROM lineitem GROUP BY l_returnflag")
def q08(spark, d):
    got = exact_percentiles(table(spark, d, "lineitem"), by="l_returnflag", value="l_extendedprice", qs={"p025": 0.025, "p50": 0.5, "p975": 0.975})
    return got.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p025", "p50", "p975")])


@query("q09_percentile_nearest", """
WITH s AS (SELECT l_shipdate, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY l_shipdate)
SELECT l_shipdate, v[CAST(round_even((len(v) - 1) * 0.025, 0) AS INT) + 1] AS low, v[CAST(round_even((len(v) - 1) * 0.975, 0) AS INT) + 1] AS high FROM s""")
def q09(spark, d):
    return exact_percentiles(table(spark, d, "lineitem"), by="l_shipdate", value="l_extendedprice", qs={"low": 0.025, "high": 0.975}, nearest=True)


def _draws_sql(size, replicates, salt):
    return f"""draws AS (SELECT (id // {size})::INT AS replicate, (('0x' || substr(md5('{salt}:' || id), 1, 12))::BIGINT % {size})::INT AS idx, count(*) AS times
  FROM range({replicates} * {size}) t(id) GROUP BY ALL)"""


@query("q10_cluster_bootstrap", f"""
WITH sums AS (SELECT c_nationkey, sum(o_totalprice) AS top, count(*) AS bottom FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
sites AS (SELECT *, (row_number() OVER (ORDER BY c_nationkey) - 1)::INT AS idx FROM sums),
{_draws_sql(25, 200, 'cluster')},
reps AS (SELECT replicate, sum(top * times) / sum(bottom * times) AS v FROM draws JOIN sites USING (idx) GROUP BY replicate)
SELECT 'mean_order_price' AS metric, round(quantile_cont(v, 0.025), 4) AS ci_low, round(quantile_cont(v, 0.975), 4) AS ci_high FROM reps""")
def q10(spark, d):
    sums = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("top"), F.count("*").alias("bottom"))
    ci = cluster_bootstrap(sums, hash_draws(spark, 200, sums.count(), salt="cluster"), {"mean_order_price": F.sum(F.col("top") * F.col("w")) / F.sum(F.col("bottom") * F.col("w"))}, cluster="c_nationkey")
    return ci.select("metric", F.round("ci_low", 4).alias("ci_low"), F.round("ci_high", 4).alias("ci_high"))


@query("q11_paired_bootstrap", f"""
WITH j AS (SELECT source, doc_id, (quality = (n_chars > 900)::INT)::INT AS web, (quality = (n_chars > 900)::INT AND toxic = 0)::INT AS gated FROM documents JOIN labels USING (doc_id)),
sources AS (SELECT source, sum(web) AS web, sum(gated) AS gated, count(*) AS n FROM j GROUP BY source),
sites AS (SELECT *, (row_number() OVER (ORDER BY source) - 1)::INT AS idx FROM sources),
{_draws_sql(20, 300, 'paired')},
reps AS (SELECT replicate, (sum(web * times) - sum(gated * times)) / sum(n * times) AS v FROM draws JOIN sites USING (idx) GROUP BY replicate),
l AS (SELECT list_sort(list(v)) AS v FROM reps)
SELECT 'gate_loss' AS metric, round(v[CAST(round_even((len(v) - 1) * 0.025, 0) AS INT) + 1], 9) AS ci_low, round(v[CAST(round_even((len(v) - 1) * 0.975, 0) AS INT) + 1], 9) AS ci_high FROM l""")
def q11(spark, d):
    right = F.col("quality") == (F.col("n_chars") > 900).cast("int")
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    sums = j.groupBy("source").agg(F.sum(right.cast("int")).alias("web"), F.sum((right & (F.col("toxic") == 0)).cast("int")).alias("gated"), F.count("*").alias("n"))
    loss = (F.sum(F.col("web") * F.col("w")) - F.sum(F.col("gated") * F.col("w"))) / F.sum(F.col("n") * F.col("w"))
    ci = cluster_bootstrap(sums, hash_draws(spark, 300, sums.count(), salt="paired"), {"gate_loss": loss}, cluster="source", percentile=percentile_nearest)
    return ci.select("metric", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


def judged_documents(spark, d):
    """Labelled documents as cases of two models, which take a text for long at different sizes; the second repeats the first's type only every third time."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    decision = lambda n: F.when(F.col("n_chars") > n, DECISIONS[1]).otherwise(DECISIONS[0])
    rows = j.select(
        F.col("doc_id").alias("ordinal"), (F.col("toxic") == 0).alias("gate_pass"), F.get(F.array(*map(F.lit, DECISIONS)), F.col("quality")).alias("gold_decision"), F.col("lang").alias("gold_type"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("model"), decision(n).alias("decision"), F.when(F.col("doc_id") % k == 0, F.col("lang")).otherwise("other").alias("kind")) for m, n, k in (("m900", 900, 2), ("m1500", 1500, 3))])).alias("a"),
    )
    rows = rows.select("a.model", "ordinal", "gate_pass", "gold_decision", "gold_type", F.col("a.decision").alias("web_pred_decision"), F.col("a.kind").alias("web_pred_type"))
    decision, kind = apply_gate(F.col("web_pred_decision"), F.col("web_pred_type"), F.col("gate_pass"))
    return rows.withColumns({"gated_pred_decision": decision, "gated_pred_type": kind})


def _weighted(condition):
    return f"sum(CASE WHEN {condition} THEN times ELSE 0 END)"


def _weighted_f1(labels, gold, pred):
    ratio = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0.0)"
    each = []
    for x in labels:
        hit, told, right = (_weighted(c) for c in (f"{gold} = '{x}' AND {pred} = '{x}'", f"{pred} = '{x}'", f"{gold} = '{x}'"))
        p, r = ratio(hit, told), ratio(hit, right)
        each.append(ratio(f"(2 * {p} * {r})", f"({p} + {r})"))
    return f"({' + '.join(each)}) / {len(labels)}"


def _weighted_scores(p):
    return f"""{_weighted(f'gold_d = {p}_d')} / sum(times) AS {p}_decision_accuracy, {_weighted_f1(DECISIONS, 'gold_d', f'{p}_d')} AS {p}_decision_macro_f1,
  {_weighted_f1(TYPES, 'gold_v', f'{p}_v')} AS {p}_violation_type_macro_f1, {_weighted(f'gold_d = {p}_d AND gold_t = {p}_t')} / sum(times) AS {p}_hierarchical_exact_match"""


REPLICATES = 400


@query("q68_paired_bootstrap_blocks", f"""
WITH base AS (SELECT m.model, doc_id, toxic = 0 AS gate, ['VIOLATION', 'NON_VIOLATION', 'INSUFFICIENT_EVIDENCE'][quality + 1] AS gold_d, lang AS gold_t,
    CASE WHEN n_chars > m.n THEN 'NON_VIOLATION' ELSE 'VIOLATION' END AS web_d, CASE WHEN doc_id % m.k = 0 THEN lang ELSE 'other' END AS web_t
  FROM documents JOIN labels USING (doc_id), (VALUES ('m900', 900, 2), ('m1500', 1500, 3)) m(model, n, k)),
gated AS (SELECT *, CASE WHEN gate THEN web_d ELSE '__BOTTOM__' END AS gated_d, CASE WHEN gate THEN web_t ELSE '__BOTTOM__' END AS gated_t, row_number() OVER (PARTITION BY model ORDER BY doc_id) - 1 AS idx FROM base),
typed AS (SELECT *, CASE WHEN gold_d = 'VIOLATION' THEN gold_t END AS gold_v, CASE WHEN gold_d = 'VIOLATION' THEN CASE WHEN web_d = 'VIOLATION' THEN web_t ELSE '__BOTTOM__' END END AS web_v,
  CASE WHEN gold_d = 'VIOLATION' THEN CASE WHEN gated_d = 'VIOLATION' THEN gated_t ELSE '__BOTTOM__' END END AS gated_v FROM gated),
sizes AS (SELECT model, count(*) AS n FROM base GROUP BY model),
draws AS (SELECT model, r AS replicate, ('0x' || substr(md5('q68:' || model || ':' || (r * n + i)), 1, 12))::BIGINT % n AS idx, count(*) AS times FROM sizes, range({REPLICATES}) a(r), range((SELECT max(n) FROM sizes)) b(i) WHERE i < n GROUP BY ALL),
scored AS (
  SELECT model, replicate, {_weighted('gate')} / sum(times) AS entry_gate_pass, {_weighted_scores('web')}, {_weighted_scores('gated')} FROM typed JOIN draws USING (model, idx) GROUP BY model, replicate
  UNION ALL SELECT model, -1, {_weighted('gate')} / sum(times), {_weighted_scores('web')}, {_weighted_scores('gated')} FROM (SELECT *, 1 AS times FROM typed) GROUP BY model),
long AS (UNPIVOT (SELECT *, web_decision_accuracy - gated_decision_accuracy AS gate_loss FROM scored) ON COLUMNS(* EXCLUDE (model, replicate)) INTO NAME metric VALUE value),
lists AS (SELECT model, metric, max(value) FILTER (replicate = -1) AS point, list_sort(list(value) FILTER (replicate >= 0)) AS v FROM long GROUP BY ALL)
SELECT model, metric, round(point, 9) AS point, round(v[CAST(round_even((len(v) - 1) * 0.025, 0) AS INT) + 1], 9) AS ci_low, round(v[CAST(round_even((len(v) - 1) * 0.975, 0) AS INT) + 1], 9) AS ci_high FROM lists""")
def q68(spark, d):
    rows = judged_documents(spark, d)
    got = bootstrap_by_patterns(rows, TYPES, replicates=REPLICATES, salt="q68")
    return got.select("model", "metric", *[F.round(c, 9).alias(c) for c in ("point", "ci_low", "ci_high")])


@query("q13_topk_rank", """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT o_custkey, min(rank) AS lowest_rank, arg_min(o_orderkey, rank) AS top1_order, bool_or(o_orderstatus = 'F' AND rank = 1) AS top1_hit, bool_or(o_orderstatus = 'F') AS topk_hit, count(*) AS k
FROM r WHERE rank <= 5 GROUP BY o_custkey""")
def q13(spark, d):
    return top_k_flags(table(spark, d, "orders"), by="o_custkey", order=[F.desc("o_totalprice"), F.col("o_orderkey")], item="o_orderkey", hit=F.col("o_orderstatus") == "F", k=5).withColumnRenamed("top1", "top1_order")


@query("q45_unpivot_metrics", """
WITH m AS (SELECT l_returnflag, avg(l_quantity) AS avg_quantity, count(*)::DOUBLE AS n_lines, max(l_discount) AS max_discount FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, metric, printf('%.12f', value) AS value_text FROM (UNPIVOT m ON avg_quantity, n_lines, max_discount INTO NAME metric VALUE value)""")
def q45(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("avg_quantity"), F.count("*").alias("n_lines"), F.max("l_discount").alias("max_discount"))
    return metric_rows(m, ["l_returnflag"], ["avg_quantity", "n_lines", "max_discount"])


@query("q46_tolerance", """
WITH a AS (SELECT l_orderkey, sum(l_quantity * 2) AS v FROM lineitem GROUP BY l_orderkey), b AS (SELECT l_orderkey, 2 * sum(l_quantity) + (l_orderkey % 5 = 0)::INT AS v FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS compared, count(*) FILTER (WHERE abs(a.v - b.v) <= 1e-12) AS within, count(*) FILTER (WHERE a.v = b.v) AS exact, max(abs(a.v - b.v)) AS max_abs_delta,
  count(*) FILTER (WHERE printf('%.12f', a.v) = printf('%.12f', b.v)) AS text_equal FROM a JOIN b USING (l_orderkey)""")
def q46(spark, d):
    li = table(spark, d, "lineitem")
    a = li.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") * 2).alias("v"))
    b = li.groupBy("l_orderkey").agg((2 * F.sum("l_quantity") + (F.col("l_orderkey") % 5 == 0).cast("int")).alias("v"))
    return within_tolerance(a, b, ["l_orderkey"], "v")


@query("q47_line_boxes", """
WITH w AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) * 10 AS x, CAST(l_linenumber AS INT) * 20 AS y, 30 AS w, 12 AS h FROM lineitem),
b AS (SELECT l_orderkey, count(*) AS words, greatest(min(x) - 7, 0) AS x0, greatest(min(y) - 7, 0) AS y0, least(max(x + w) + 7, 500) AS x1, least(max(y + h) + 7, 160) AS y1 FROM w GROUP BY l_orderkey)
SELECT x0, y0, x1, y1, count(*) AS lines, min(l_orderkey) AS first_line FROM b GROUP BY ALL""")
def q47(spark, d):
    from tallyloom.operators.integrity import bounding_boxes

    w = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("int") * 10).alias("x"), (F.col("l_linenumber") * 20).alias("y"), F.lit(30).alias("w"), F.lit(12).alias("h"))
    b = bounding_boxes(w, by=["l_orderkey"], pad=7, width=500, height=160)
    return b.groupBy("x0", "y0", "x1", "y1").agg(F.count("*").alias("lines"), F.min("l_orderkey").alias("first_line"))
