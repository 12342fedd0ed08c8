"""Rules, closures and metadata queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import graph, integrity, ranking
from tallyloom.operators.rules import Rule, check_counts, policy_for, union, verdicts, violations
from tallyloom.plans.registry import query, table

EDGES_SQL = "edges AS (SELECT n_regionkey::BIGINT AS case_id, n_nationkey::BIGINT AS src, (n_nationkey * 7 + 5) % 25 AS dst FROM nation WHERE n_nationkey % 4 <> 1)"


@query("q42_closure", f"""
WITH RECURSIVE {EDGES_SQL}, e AS (SELECT 1 AS case_id, src, dst::BIGINT AS dst FROM edges),
reach(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)
SELECT src, count(*) AS reachable, bool_or(src = dst) AS in_cycle FROM reach GROUP BY src""")
def q42(spark, d):
    e = table(spark, d, "nation").where("n_nationkey % 4 <> 1").select(F.lit(1).alias("case_id"), F.col("n_nationkey").cast("bigint").alias("src"), ((F.col("n_nationkey") * 7 + 5) % 25).cast("bigint").alias("dst"))
    return graph.closure(e).groupBy("src").agg(F.count("*").alias("reachable"), F.bool_or(F.col("src") == F.col("dst")).alias("in_cycle"))


ORDER_RULES = (
    ("price:high", "o_totalprice > 450000", "warning"), ("price:low", "o_totalprice < 2000", "error"), ("status:open_old", "o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1993-01-01 00:00:00'", "blocker"),
    ("priority:unspecified", "o_orderpriority = '4-NOT SPECIFIED'", "warning"), ("customer:zero", "o_custkey = 0", "error"), ("key:round", "o_orderkey % 1000 = 0", "warning"),
    ("conclusion:competing_status", "o_orderstatus = 'P' AND o_orderkey % 13 = 0", "blocker"), ("priority:urgent_cheap", "o_orderpriority = '1-URGENT' AND o_totalprice < 20000", "blocker"),
)


def _collected(severity):
    parts = " || ".join(f"CASE WHEN {c} THEN ['{code}'] ELSE []::VARCHAR[] END" for code, c, s in ORDER_RULES if s == severity)
    return f"list_sort({parts})"


@query("q44_rules_union", f"""
WITH v AS (SELECT o_orderkey, {_collected('error')} AS errors, {_collected('blocker')} AS blockers, {_collected('warning')} AS warnings FROM orders)
SELECT *, CASE WHEN len(errors) > 0 THEN 'INVALID_EVIDENCE' WHEN len(list_filter(blockers, lambda x: starts_with(x, 'conclusion:competing'))) > 0 THEN 'CONFLICTING_EVIDENCE' WHEN len(blockers) > 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'VALID' END AS outcome FROM v""")
def q44(spark, d):
    o = table(spark, d, "orders")
    found = union([violations(o, [Rule(code, F.expr(c), s) for code, c, s in ORDER_RULES], "o_orderkey")])
    return verdicts(o.select("o_orderkey"), found, "o_orderkey")


@query("q56_check_counts", " UNION ALL ".join(f"SELECT '{code}' AS code, count(*) AS checked, count(*) FILTER (WHERE NOT ({c})) AS passed FROM orders" for code, c, _ in ORDER_RULES))
def q56(spark, d):
    return check_counts(table(spark, d, "orders"), [Rule(code, F.expr(c), s) for code, c, s in ORDER_RULES])


@query("q57_source_selection", """
WITH t AS (SELECT o_custkey || '--v' || lpad((o_orderkey % 6)::VARCHAR, 3, '0') AS sample_id, o_orderkey AS line_no FROM orders),
p AS (SELECT *, regexp_extract(sample_id, '^(.*)--v[0-9]{3}$', 1) AS source_id, regexp_extract(sample_id, '--v([0-9]{3})$', 1)::INT AS variant FROM t),
f AS (SELECT source_id, row_number() OVER (ORDER BY min(line_no), source_id) AS place FROM p GROUP BY source_id)
SELECT source_id, sample_id, line_no, variant FROM p WHERE variant IN (0, 3) AND source_id IN (SELECT source_id FROM f WHERE place > 10 AND place <= 60)""")
def q57(spark, d):
    t = table(spark, d, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit("--v"), F.lpad((F.col("o_orderkey") % 6).cast("string"), 3, "0")).alias("sample_id"), F.col("o_orderkey").alias("line_no"))
    return ranking.select_sources(t, offset=10, limit=50, variants=[0, 3]).select("source_id", "sample_id", "line_no", "variant")


@query("q58_policy_case", "SELECT CASE WHEN starts_with(p_name, 'red') THEN 'warm' WHEN starts_with(p_name, 'blue') THEN 'cold' ELSE 'none' END AS policy, count(*) AS n FROM part GROUP BY 1")
def q58(spark, d):
    return table(spark, d, "part").groupBy(policy_for(F.col("p_name"), [("red", "warm"), ("blue", "cold")], "none").alias("policy")).agg(F.count("*").alias("n"))


@query("q59_contiguity", """
WITH r AS (SELECT l_orderkey, list(l_linenumber::INT ORDER BY l_linenumber) AS ranks, list(l_discount ORDER BY l_linenumber, l_discount) AS conf FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, ranks = list_transform(range(1, len(ranks) + 1), lambda x: x::INT) AS contiguous, len(list_filter(range(2, len(conf) + 1), lambda i: conf[i::INT] > conf[(i - 1)::INT])) = 0 AS not_increasing FROM r""")
def q59(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount"))).alias("x"))
    r = r.select("l_orderkey", F.transform("x", lambda v: v["l_linenumber"]).alias("ranks"), F.transform("x", lambda v: v["l_discount"]).alias("conf"))
    return r.select("l_orderkey", ranking.ranks_contiguous(F.col("ranks")).alias("contiguous"), ranking.not_increasing(F.col("conf")).alias("not_increasing"))


@query("q60_asymmetric_pairs", """
WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_quantity > 49)
SELECT a, b, 'asymmetric' AS code FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.a = x.b AND y.b = x.a) UNION ALL SELECT a, b, 'self' FROM p WHERE a = b""")
def q60(spark, d):
    p = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")).distinct()
    return integrity.asymmetric_pairs(p, "a", "b")
