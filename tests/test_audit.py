import pytest
from pyspark.sql import functions as F

from tallyloom.functions.rng import Stream
from tallyloom.operators import evidence, graph, integrity, ranking, rules, state, transform
from tallyloom.plans import fixtures


def test_evidence_audit(spark):
    got = {r.case_id: r for r in evidence.audit(fixtures.cases(spark, fixtures.broken_cases())).collect()}
    assert (got["c1"].outcome, got["c1"].errors, got["c1"].blockers, got["c1"].warnings) == ("SUPPORTED_HIGH_RISK", [], [], [])
    assert got["empty"].outcome == "INVALID_EVIDENCE" and "propositions:target_count:0" in got["empty"].errors and "evidence_gate_failed:capture_complete" in got["empty"].errors
    assert got["gate"].errors == ["evidence_gate_failed:integrity_verified"]
    assert {"inference_cycle:I1", "inference_cycle:I2", "inference:I2:unknown_agent:AG9"} <= set(got["cycle"].errors)
    assert got["scope"].outcome == "INSUFFICIENT_EVIDENCE" and got["scope"].warnings == ["negative_observation:E2:incomplete_search_scope"]
    assert got["rival"].outcome == "CONFLICTING_EVIDENCE"
    assert "conclusion:material_alternatives_unresolved:ALT1" in got["open"].blockers
    assert got["groups"].blockers == ["conclusion:independent_support_groups=2<3"]
    assert got["twice"].errors == ["observation[2]:duplicate_id:E1"]


def test_artifacts(spark):
    cases = fixtures.cases(spark, [fixtures.case()])
    real = spark.createDataFrame([("c1", "a/1.txt", "0" * 64), ("c1", "a/2.txt", "1" * 64)], "case_id string, path string, sha256 string")
    assert evidence.audit(cases, real).first().errors == ["entity:ART2:artifact_sha256_mismatch", "entity:ART3:artifact_missing"]


def test_graph(spark):
    e = spark.createDataFrame([("c", 1, 2), ("c", 2, 3), ("c", 3, 1), ("c", 3, 4), ("d", 1, 9)], "case_id string, src int, dst int")
    pairs = graph.closure(e)
    assert {r.node for r in graph.cycle_nodes(pairs).collect()} == {1, 2, 3}
    leaves = spark.createDataFrame([("c", 4), ("d", 9)], "case_id string, leaf int")
    assert {(r.case_id, r.src): r.leaves for r in graph.leaves_under(pairs, leaves, case="case_id", src="src", dst="dst", leaf="leaf").collect()} == {("c", 1): [4], ("c", 2): [4], ("c", 3): [4], ("d", 1): [9]}
    with pytest.raises(RuntimeError):
        graph.closure(spark.range(12).selectExpr("'c' case_id", "id src", "id + 1 dst"), max_depth=5)
    assert graph.closure(e.where("false")).count() == 0


def test_frozen_outcomes(spark):
    a = spark.createDataFrame([
        ("a", 1, False, False, "FAIL", False), ("a", 2, True, True, "PASS", True), ("a", 3, True, True, "FAIL", False), ("b", 1, True, True, "FAIL", True), ("b", 2, True, True, "PASS", True),
        ("c", 1, True, False, "FAIL", False), ("d", 1, True, True, "PASS", False), ("d", 2, True, True, "PASS", True),
    ], "sample_id string, attempt int, has_audit boolean, output_observed boolean, status string, has_prediction boolean")
    tasks = spark.createDataFrame([(x,) for x in "abcde"], "sample_id string")
    got = {r.sample_id: tuple(r)[1:] for r in state.frozen_outcomes(a, tasks).collect()}
    assert got == {"a": ("PASS", 2, 1, 1, False), "b": ("MODEL_FAILURE", 1, 0, 1, True), "c": ("SYSTEM_FAILURE_EXHAUSTED", None, 1, 0, False), "d": ("PASS", 2, 1, 0, False), "e": ("SYSTEM_FAILURE_EXHAUSTED", None, 0, 0, False)}
    n = state.accounting(state.frozen_outcomes(a, tasks), 5).first()
    assert (n.valid, n.failed, n.masked_successes) == (2, 3, 1)
    with pytest.raises(Exception, match="add up"):
        state.accounting(state.frozen_outcomes(a, tasks), 6).collect()


def test_state_helpers(spark):
    r = spark.createDataFrame([("m", "PASS", None), ("m", "PASS", "m"), ("n", "PASS", "x"), ("n", "PASS", "y"), ("o", "FAIL", "o")], "model string, status string, response_model string")
    assert [tuple(x) for x in state.qualified_models(r).collect()] == [("m", "m")]
    d = spark.range(4).select(state.retry_delay(F.col("id").cast("int"), [1, 5], F.when(F.col("id") == 0, F.lit(3.0))))
    assert [x[0] for x in d.collect()] == [3.0, 5.0, 5.0, 5.0]
    kinds = spark.createDataFrame([(None, True, "x"), (429, True, "x"), (404, True, "x"), (200, False, "x"), (200, True, ""), (200, True, "x")], "s int, j boolean, c string")
    assert [x[0] for x in kinds.select(state.error_kind(F.col("s"), F.col("j"), F.col("c"))).collect()] == ["RETRY", "RETRY", "TERMINAL", "RETRY", "RETRY", "OK"]
    with pytest.raises(Exception, match="another configuration"):
        state.unprocessed(r, r.withColumn("fingerprint", F.lit("b")), "model", fingerprint="a").collect()


def test_ranking_and_integrity(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c).first()[0]
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert ask(ranking.ranks_contiguous(arr(2, 1, 3))) and not ask(ranking.ranks_contiguous(arr(1, 3)))
    assert ask(ranking.not_increasing(arr(0.5, 0.5, 0.1))) and not ask(ranking.not_increasing(arr(0.1, 0.5)))
    assert one.agg(ranking.next_number(F.lit(None).cast("int"))).first()[0] == "001"
    got = integrity.zipped(spark.createDataFrame([(1, "a")], "line_no int, x string"), spark.createDataFrame([(1, "b")], "line_no int, x string")).first()
    assert (got.x, got.right_x) == ("a", "b")
    with pytest.raises(Exception, match="different rows"):
        integrity.zipped(spark.createDataFrame([(1, "a")], "line_no int, x string"), spark.createDataFrame([(2, "b")], "line_no int, x string")).collect()
    t = spark.createDataFrame([("i", "g1", "g1"), ("j", "g1", "g2"), ("j", "g2", "g2")], "i string, g string, d string")
    assert {r.i: r.ok for r in integrity.sole_membership(t, item="i", group="g", declared="d").collect()} == {"i": True, "j": False}


def test_schema_rules(spark):
    schema = {"properties": {"id": {"pattern": "^[a-z]+$"}, "n": {"minimum": 1, "maximum": 3}, "kind": {"enum": ["x", "y"]}, "tags": {"minItems": 1, "uniqueItems": True}, "rows": {"items": {"properties": {"k": {"enum": ["a"]}}, "required": ["k"]}}}, "required": ["id"]}
    rows = [(1, ("ab", 2, "x", ["p"], [("a",)])), (2, (None, 9, "z", ["p", "p"], [(None,), ("b",)])), (3, ("A", 0, "y", [], []))]
    df = spark.createDataFrame(rows, "i int, v struct<id:string,n:int,kind:string,tags:array<string>,rows:array<struct<k:string>>>")
    got = {}
    for r in rules.violations(df, rules.schema_rules(schema, "v"), "i").collect():
        got.setdefault(r.i, set()).add(r.code.removeprefix("schema:$."))
    assert got == {2: {"id:required", "n:maximum", "kind:enum", "tags:uniqueItems", "rows[].k:required", "rows[].k:enum"}, 3: {"id:pattern", "n:minimum", "tags:minItems"}}
    assert rules.forbidden_names(df.schema, {"k", "id"}) == ["$.v.id", "$.v.rows[].k"]
    ask = lambda c: spark.range(1).select(c).first()[0]
    assert ask(rules.unknown_keys(F.lit('{"b":1,"a":2}'), ["a"])) == ["b"]
    assert ask(rules.forbidden_json_keys(F.lit('{"x":[{"Gold":1}]}'), ["gold"])) == ["gold"]
    assert [ask(rules.portable_path(F.lit(p))) for p in ("a/b", "/a", "a/../b", "")] == [True, False, False, False]
    leak = spark.createDataFrame([("secret-ref in text", "secret-ref"), ("fine", "secret-ref")], "t string, p string")
    assert [r[0] for r in leak.select("t", "p").select(rules.leaks(leak.select("t"), [F.col("p")])).collect()] == [True, False]


LEX = [{"rule_id": "a", "source": "then", "candidates": ["zen", "zan"], "probability": 0.7}, {"rule_id": "b", "source": "the", "candidates": ["da"], "probability": 0.9}]


@pytest.mark.parametrize("seed", range(8))
def test_transforms_invert(seed):
    recipe = transform.Recipe(homophones=tuple(LEX), glyphs=({"rule_id": "g", "source": "o", "candidates": ["0"], "probability": 0.5},), markers=({"rule_id": "m", "value": "·"},), confusables={"o": [("c", "ο")], "e": [("d", "е"), ("f", "ė")]}, tokens=("[ok]", ":x:"), columns=seed % 3)
    stages = transform.message_stages("m1", "then the end of {{ENTRY}} is there", "https://one.test/path", recipe, f"s{seed}")
    assert transform.verify_stages(stages) == []
    assert transform.message_stages("m1", "then the end of {{ENTRY}} is there", "https://one.test/path", recipe, f"s{seed}")[-1].output_text == stages[-1].output_text
    for s in stages:
        if s.edits:
            assert transform.invert_edits(s.output_text, s.edits) == s.input_text


def test_transform_guards():
    for bad in ("https://evil.com/", "ftp://one.test/", "http://u:p@one.test/", "one\\.test", "a.test evil.com"):
        with pytest.raises(ValueError):
            transform.safe_entry(bad)
    with pytest.raises(transform.BadEdit):
        transform.apply_edits("abc", [transform.Edit(0, 2, "ab", "x"), transform.Edit(1, 3, "bc", "y")])
    with pytest.raises(ValueError):
        transform.compose_edit("no place", "x")
    with pytest.raises(ValueError):
        transform.substitution_edits("https://127.0.0.1/", {"q": [("r", "x")]}, Stream("s"), probability=1, least=1)
    units = transform.layout_units("ab[ok]c\n")
    assert units == ["a", "b", "[ok]", "c", "⏎"] and transform.columns_inverse(transform.columns_layout(units, 2)) == units
    assert transform.diagonal_inverse(transform.diagonal_layout(units, "xyz", Stream("d"), width=3)) == units


def test_records(spark):
    src = spark.createDataFrame([("s", "one.test", [("m", "see {{ENTRY}}", True)])], "session_id string, entry string, messages array<struct<message_id:string,text:string,transform:boolean>>")
    rec = transform.expand_variants(src, [transform.Recipe(0), transform.Recipe(1, confusables={"o": [("c", "ο")]})], seed="g")
    assert transform.stage_violations(rec).count() == 0 and rec.count() == 2
    broken = rec.withColumn("stages", F.transform("stages", lambda s: s.withField("output_text", F.concat(s["output_text"], F.lit("!")))))
    assert transform.stage_violations(broken).count() > 0
    m = transform.confusable_map(spark.createDataFrame([("a", "α", 0)], "target string, value string, position int"), spark.createDataFrame([("a", "а", 0), ("a", "α", 1), ("b", "ь", 2)], "target string, value string, position int"), limit=1)
    assert sorted(map(tuple, m.collect())) == [("a", "α", 1), ("b", "ь", 1)] and transform.uncovered_letters(m).count() == 24
