"""State, accounting and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import integrity, state
from tallyloom.plans.registry import query, table


@query("q14_first_observed", """
WITH f AS (SELECT user_id, min(event_id) FILTER (WHERE event_type <> 'error') AS first_id FROM events GROUP BY user_id)
SELECT e.user_id, any_value(f.first_id) AS first_id, max(e.event_type) FILTER (WHERE e.event_id = f.first_id) AS outcome,
  count(*) FILTER (WHERE f.first_id IS NULL OR e.event_id < f.first_id) AS failures_before, count(*) FILTER (WHERE e.event_id > f.first_id) AS ignored_later
FROM events e JOIN f USING (user_id) GROUP BY e.user_id""")
def q14(spark, d):
    got = state.first_observed(table(spark, d, "events").select("user_id", "event_id", "event_type"), by="user_id", order=F.col("event_id"), observed=F.col("event_type") != "error")
    return got.select("user_id", F.col("outcome.event_id").alias("first_id"), F.col("outcome.event_type").alias("outcome"), "failures_before", "ignored_later")


@query("q15_latest_state", "SELECT user_id, event_type, min(event_id) AS created_at, max(event_id) AS updated_at, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def q15(spark, d):
    return state.latest_state(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("q16_status_rollup", """
WITH s AS (SELECT user_id, event_type, CASE arg_max(event_id, event_id) % 5 WHEN 0 THEN 'PARTIAL' WHEN 1 THEN 'RUNNING' ELSE 'DONE' END AS state FROM events WHERE event_id % 7 <> 0 GROUP BY ALL),
g AS (SELECT u.user_id, t.event_type, coalesce(s.state, 'PENDING') AS state FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN s ON s.user_id = u.user_id AND s.event_type = t.event_type)
SELECT user_id, count(*) AS pairs, count(*) FILTER (WHERE state = 'PENDING') AS pending,
  CASE WHEN bool_and(state = 'DONE') THEN 'COMPLETE' WHEN bool_and(state IN ('DONE', 'PARTIAL')) THEN 'COMPLETE_WITH_PARTIAL' ELSE 'RUNNING' END AS overall FROM g GROUP BY user_id""")
def q16(spark, d):
    ev = table(spark, d, "events")
    last = ev.where("event_id % 7 <> 0").groupBy("user_id", "event_type").agg(F.max("event_id").alias("e"))
    s = last.select("user_id", "event_type", F.when(F.col("e") % 5 == 0, "PARTIAL").when(F.col("e") % 5 == 1, "RUNNING").otherwise("DONE").alias("state"))
    return state.rolled_up(s, ev, ev, a="user_id", b="event_type", state="state", complete="DONE", partial="PARTIAL")


@query("q17_retry_counts", """
WITH p AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS f FROM events GROUP BY user_id)
SELECT count(*) AS tasks, sum(greatest(n - 1, 0))::BIGINT AS retries, sum(f)::BIGINT AS failures FROM p""")
def q17(spark, d):
    ev = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("status"))
    return state.retry_counts(ev, "user_id", "status")


@query("q18_resume_anti", "SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE ('0x' || substr(md5('done:' || event_id), 1, 8))::BIGINT % 3 <> 0)")
def q18(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id")
    h = F.conv(F.substring(F.md5(F.concat(F.lit("done:"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return state.unprocessed(ev, ev.where(h % 3 != 0), "event_id")


@query("q19_usage_map_sum", "SELECT event_type, key, sum(CAST(json_extract(props, '$.' || key) AS BIGINT))::BIGINT AS total FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) GROUP BY event_type, key")
def q19(spark, d):
    ev = table(spark, d, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("usage"))
    return state.usage_sums(ev, ["event_type"], "usage")


@query("q20_ref_integrity", """
SELECT l_orderkey, 'lineitem:unknown_reference:' || l_partkey AS code FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 10 <> 0)
UNION ALL SELECT l_orderkey, 'order:unknown_reference:' || l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def q20(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    a = integrity.unknown_references(li, table(spark, d, "part").where("p_size % 10 <> 0"), value="l_partkey", id_column="p_partkey", prefix="lineitem")
    b = integrity.unknown_references(li, table(spark, d, "orders").where("o_orderstatus <> 'P'"), value="l_orderkey", id_column="o_orderkey", prefix="order")
    return a.select("l_orderkey", "code").unionAll(b.select("l_orderkey", "code"))


@query("q21_dup_keys", """
WITH n AS (SELECT role, length(text) % 50 AS size, conv_id, turn, row_number() OVER (PARTITION BY role, length(text) % 50 ORDER BY conv_id, turn) AS rn FROM conversations)
SELECT role, size, min(conv_id) FILTER (WHERE rn = 1) AS first_conv, count(*) FILTER (WHERE rn > 1) AS later FROM n GROUP BY role, size""")
def q21(spark, d):
    c = table(spark, d, "conversations").select("role", (F.length("text") % 50).alias("size"), "conv_id", "turn")
    first, later = integrity.first_wins(c, ["role", "size"], ["conv_id", "turn"])
    n = later.groupBy("role", "size").agg(F.count("*").alias("later"))
    return first.select("role", "size", F.col("conv_id").alias("first_conv")).join(n, ["role", "size"], "left").select("role", "size", "first_conv", F.coalesce("later", F.lit(0)).alias("later"))


@query("q22_turn_contiguity", """
WITH g AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous, count(*) FILTER (WHERE before = role) AS repeats FROM g GROUP BY conv_id""")
def q22(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    repeats = state.changes(c, "conv_id", "turn", "role").groupBy("conv_id").agg(F.count_if(F.col("before") == F.col("role")).alias("repeats"))
    return state.gaps(c, "conv_id", "turn").join(repeats, "conv_id")


@query("q23_alignment", """
WITH m AS (SELECT unnest(['a', 'b', 'c']) AS model), r AS (SELECT m.model, doc_id AS ordinal, quality, CASE WHEN m.model = 'c' AND doc_id % 50 = 0 THEN 1 - toxic ELSE toxic END AS toxic FROM labels, m WHERE NOT (m.model = 'b' AND doc_id % 71 = 0))
SELECT ordinal, count(DISTINCT (quality, toxic)) AS variants, count(DISTINCT model) AS models FROM r GROUP BY ordinal HAVING count(DISTINCT (quality, toxic)) <> 1 OR count(DISTINCT model) <> 3 OR count(*) <> 3""")
def q23(spark, d):
    from tallyloom.operators.statistics import aligned

    r = table(spark, d, "labels").withColumn("model", F.explode(F.array(*[F.lit(x) for x in "abc"]))).where("NOT (model = 'b' AND doc_id % 71 = 0)")
    r = r.select("model", F.col("doc_id").alias("ordinal"), "quality", F.expr("IF(model = 'c' AND doc_id % 50 = 0, 1 - toxic, toxic)").alias("toxic"))
    return aligned(r, gold=("quality", "toxic"))


@query("q24_set_algebra", """
WITH s AS (SELECT l_orderkey, coalesce(list_distinct(list(l_suppkey) FILTER (WHERE l_linenumber <= 3)), []) AS a, coalesce(list_distinct(list(l_suppkey) FILTER (WHERE l_linenumber >= 2)), []) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS only_b,
  list_sort(list_intersect(a, b)) AS "both", list_sort(a) = list_sort(b) AS equal FROM s""")
def q24(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") >= 2, F.col("l_suppkey"))).alias("b"))
    return s.select("l_orderkey", *[c.alias(k) for k, c in integrity.set_algebra(F.col("a"), F.col("b")).items()])


@query("q43_producers", """
WITH p AS (SELECT l_partkey, list_sort(list_distinct(list(l_suppkey::VARCHAR))) AS producers FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey)
SELECT p_partkey, coalesce(producers, []) AS producers FROM part LEFT JOIN p ON p_partkey = l_partkey WHERE coalesce(len(producers), 0) <> 1""")
def q43(spark, d):
    from tallyloom.operators.graph import producers

    out = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("activity"))
    return producers(out, table(spark, d, "part"), entity="p_partkey", activity="activity")


@query("q49_state_coverage", """
WITH h AS (SELECT user_id, coalesce(list_distinct(list(event_type) FILTER (WHERE value > 60)), []) AS had FROM events GROUP BY user_id)
SELECT user_id, list_sort(list_filter(['click', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(had, x))) AS missing,
  CASE WHEN len(list_filter(['click', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(had, x))) = 0 THEN 'PASS' WHEN len(list_intersect(['click', 'purchase', 'signup', 'view'], had)) > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM h""")
def q49(spark, d):
    h = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("had"))
    return h.select("user_id", *[c.alias(k) for k, c in integrity.covered(F.array(*[F.lit(x) for x in ("click", "purchase", "signup", "view")]), F.col("had")).items()])


@query("q51_reconciliation", """
WITH a AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS k FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY o_custkey HAVING o_custkey % 31 <> 0)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'left_only' WHEN a.o_custkey IS NULL THEN 'right_only' WHEN a.n = b.n AND a.k = b.k THEN 'equal' ELSE 'differs' END AS state
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def q51(spark, d):
    o = table(spark, d, "orders")
    per = lambda x: x.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderstatus").alias("k"))
    return integrity.reconciled(per(o), per(o.where("o_orderkey % 97 <> 0 AND o_custkey % 31 <> 0")), "o_custkey")


@query("q52_frozen_outcomes", """
WITH a AS (SELECT user_id AS sample_id, event_id AS attempt, event_type <> 'error' AS has_audit, value > 20 AS output_observed, CASE WHEN event_type = 'purchase' THEN 'PASS' ELSE 'FAIL' END AS status, event_id % 4 <> 0 AS has_prediction FROM events),
k AS (SELECT *, has_audit AND output_observed AND NOT (status = 'PASS' AND NOT has_prediction) AS decides FROM a),
f AS (SELECT sample_id, min(attempt) FILTER (WHERE decides) AS first_at, bool_or(has_prediction) AS raw FROM k GROUP BY sample_id),
s AS (SELECT k.sample_id, any_value(first_at) AS deciding_attempt, coalesce(max(status) FILTER (WHERE attempt = first_at), 'NONE') AS st, any_value(raw) AS raw,
  count(*) FILTER (WHERE first_at IS NULL OR attempt < first_at) AS failures_before, count(*) FILTER (WHERE attempt > first_at) AS ignored_later FROM k JOIN f USING (sample_id) GROUP BY k.sample_id)
SELECT sample_id, CASE st WHEN 'NONE' THEN 'SYSTEM_FAILURE_EXHAUSTED' WHEN 'PASS' THEN 'PASS' ELSE 'MODEL_FAILURE' END AS final_status, deciding_attempt, failures_before, ignored_later, raw AND st <> 'PASS' AS masked_success FROM s""")
def q52(spark, d):
    a = table(spark, d, "events").select(
        F.col("user_id").alias("sample_id"), F.col("event_id").alias("attempt"), (F.col("event_type") != "error").alias("has_audit"), (F.col("value") > 20).alias("output_observed"),
        F.when(F.col("event_type") == "purchase", "PASS").otherwise("FAIL").alias("status"), (F.col("event_id") % 4 != 0).alias("has_prediction"),
    )
    return state.frozen_outcomes(a, a.select("sample_id").distinct())
