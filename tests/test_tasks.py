import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import browsing, rules, tasks

GOOD = {"reconstructed_messages": [{"message_id": "m1", "text": "open one.test now"}], "intent_label": "OPEN_SITE", "platform": "CHAT", "entry_candidates": [{"rank": 1, "value": "one.test", "confidence": 0.9}, {"rank": 2, "value": "two.example", "confidence": 0.2}], "abstain": False, "uncertainties": []}


def test_response_codes(spark):
    bad = {
        "good": GOOD, "keys": {**GOOD, "more": 1}, "ids": {**GOOD, "reconstructed_messages": [{"message_id": "m2", "text": "x"}]}, "unsafe": {**GOOD, "reconstructed_messages": [{"message_id": "m1", "text": "go evil.com"}]},
        "live": {**GOOD, "entry_candidates": [{"rank": 1, "value": "evil.com", "confidence": 0.9}]}, "ranks": {**GOOD, "entry_candidates": [{"rank": 2, "value": "one.test", "confidence": 0.9}]},
        "rising": {**GOOD, "entry_candidates": [{"rank": 1, "value": "one.test", "confidence": 0.1}, {"rank": 2, "value": "one.test", "confidence": 0.4}]}, "none": {**GOOD, "entry_candidates": []}, "platform": {**GOOD, "platform": "MAIL"},
    }
    t = spark.createDataFrame([(k, "CHAT", [("m1",)]) for k in bad], "sample_id string, platform string, messages array<struct<message_id:string>>")
    r = spark.createDataFrame([(k, json.dumps(v)) for k, v in bad.items()], "sample_id string, raw string")
    got = {x.sample_id: x.codes for x in tasks.response_codes(t, r).collect()}
    assert got == {
        "good": [], "keys": ["SEMANTIC_KEYS_INVALID"], "ids": ["RECONSTRUCTED_MESSAGE_IDS_INVALID"], "unsafe": ["RECONSTRUCTED_MESSAGE_SAFETY_INVALID"], "live": ["ENTRY_CANDIDATE_SAFETY_INVALID"],
        "ranks": ["ENTRY_CANDIDATE_RANKS_NOT_CONTIGUOUS"], "rising": ["ENTRY_CANDIDATE_CONFIDENCE_NOT_MONOTONIC"], "none": ["NON_ABSTAIN_REQUIRES_CANDIDATE"], "platform": ["PLATFORM_INVALID"],
    }


def test_projection_and_predictions(spark):
    rec = spark.createDataFrame([("s", "chat", [("m1", "t")])], "sample_id string, platform string, messages array<struct<message_id:string,text:string>>")
    row = tasks.task_rows(rec, context={"platform": F.col("platform")}, constants={"view": "text"}, version="0.1").first()
    assert row.messages[0].content == "t" and len(row.task_sha256) == 64 and row["view"] == "text"
    typed = spark.createDataFrame([("s", json.dumps(GOOD))], "sample_id string, raw string").select("sample_id", F.from_json("raw", tasks.RESPONSE).alias("r"))
    p = tasks.prediction_rows(typed, model="m", run_id="r").first()
    assert (p.intent, p.platform, p.candidates[0].confidence) == ("open site", "chat", 0.9)
    odd = spark.createDataFrame([("s", json.dumps({"entry_candidates": [{"rank": 9, "value": "a"}] * 7}))], "sample_id string, raw string").select("sample_id", F.from_json("raw", tasks.RESPONSE).alias("r"))
    assert [(c.rank, c.confidence) for c in tasks.reranked(odd).first().candidates] == [(i, 0.5) for i in range(1, 6)]


def test_judgments_actions_policies(spark):
    good = {"intent": "i", "evidence": [{"evidence_id": "E1", "observation": "o"}], "risk_reason": "r", "answer": "YES", "evidence_sufficiency": "SUFFICIENT", "counterevidence": []}
    rows = [(1, json.dumps(good)), (2, json.dumps({**good, "evidence": [{"evidence_id": "E9", "observation": " "}], "answer": "MAYBE"})), (3, json.dumps({**good, "evidence": []})), (4, json.dumps({**good, "evidence": [{"evidence_id": "E2", "observation": "o"}]}))]
    df = spark.createDataFrame([(i, r, ["E1", "E2"], ["E1"]) for i, r in rows], "i int, raw string, known array<string>, visible array<string>")
    got = {}
    for v in rules.violations(df, tasks.judgment_rules("raw", "known", "visible"), "i").collect():
        got.setdefault(v.i, set()).add(v.code)
    assert got == {2: {"JUDGMENT_ANSWER_INVALID", "JUDGMENT_UNKNOWN_EVIDENCE_ID", "JUDGMENT_EMPTY_OBSERVATION"}, 3: {"JUDGMENT_EVIDENCE_EMPTY"}, 4: {"JUDGMENT_CITATION_NOT_MODEL_VISIBLE"}}
    a = spark.createDataFrame([(1, '{"action_id":"a","reason":"r","visual_observations":[]}', "a"), (2, '{"action_id":"b","reason":" ","x":1}', "a")], "i int, raw string, want string")
    assert {(v.i, v.code) for v in rules.violations(a, tasks.action_rules("raw", "want"), "i").collect()} == {(2, "ACTION_KEYS_INVALID"), (2, "ACTION_REASON_INVALID"), (2, "ACTION_VISUAL_OBSERVATIONS_INVALID"), (2, "ACTION_ID_INVALID")}
    g = spark.createDataFrame([("gpt-5.2", {}), ("gpt-5.2", {"temperature": "0"}), ("qwen3", {"temperature": "0"}), ("kimi-k2", {"temperature": "0", "thinking": "disabled"}), ("other", {"temperature": "0", "thinking": "x"})], "m string, o map<string,string>")
    assert sorted(v.code for v in rules.violations(g, tasks.generation_rules("m", "o"), "m").collect()) == ["ENABLE_THINKING_NOT_FALSE", "TEMPERATURE_MUST_BE_OMITTED", "THINKING_OVERRIDE_UNEXPECTED"]


def test_sources_recipes_scopes(spark):
    s = spark.createDataFrame([("ok", [("a", "x {{ENTRY}}", True), ("b", "y", False)]), ("bad", [("a", "x", True), ("a", "{{ENTRY}}", False)]), ("no", [("a", "x", False)])], "i string, messages array<struct<message_id:string,text:string,transform:boolean>>")
    got = {}
    for v in rules.violations(s, tasks.source_rules(), "i").collect():
        got.setdefault(v.i, set()).add(v.code.removeprefix("messages:"))
    assert got == {"bad": {"duplicate_id", "placeholder_count", "stray_placeholder"}, "no": {"none_transformed"}}
    r = spark.createDataFrame([(1, [(1, False), (0, True)]), (2, [(0, True), (2, True)])], "i int, recipes array<struct<variant_index:int,primary:boolean>>")
    assert {(v.i, v.code) for v in rules.violations(r, tasks.recipe_rules(), "i").collect()} == {(2, "recipes:indices_not_contiguous"), (2, "recipes:primary_count")}
    import hashlib

    good = hashlib.sha256(b"a\nb\n").hexdigest()
    c = spark.createDataFrame([(["b", "a"], 2, good), (["a", "a"], 2, good), (["a"], 2, good), (["a", "c"], 2, good), ([], 0, good)], "s array<string>, n int, h string")
    assert [x[0] for x in c.select(tasks.scope_state(F.col("s"), F.col("n"), F.col("h"))).collect()] == ["OK", "duplicates", "count", "digest", "empty"]


def test_small_helpers(spark):
    ask = lambda c: spark.range(1).select(c).first()[0]
    assert ask(tasks.smoke_entry(F.lit("`HTTPS://One.Test:8/a/start/?q`"))) == "https://one.test/a/start" and ask(tasks.smoke_entry(F.lit("one.test"))) == "one.test" and ask(tasks.smoke_entry(F.lit("https://one.test"))) == "https://one.test/"
    assert ask(tasks.json_path(F.array(F.lit("a"), F.lit("0"), F.lit("b")))) == "$.a[0].b" and ask(tasks.at_path(F.lit('{"a":[{"b":5}]}'), "a.0.b")) == "5"
    with pytest.raises(Exception, match="missing"):
        ask(tasks.at_path(F.lit('{"a":1}'), "b"))
    places = spark.createDataFrame([("x", 1), ("y", 2)], "case_ref string, ordinal int")
    rows = spark.createDataFrame([("x",), ("y",)], "case_ref string")
    assert {tuple(r) for r in tasks.by_ordinal(rows, places).collect()} == {("x", 1), ("y", 2)}
    with pytest.raises(Exception, match="one to one"):
        tasks.by_ordinal(rows, spark.createDataFrame([("x", 1), ("y", 1)], "case_ref string, ordinal int")).collect()
    m = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "C"), ("d", "D")], "model string, display_model string")
    assert [r.model for r in tasks.published(m, spark.createDataFrame([("A",), ("B",)], "n string")).collect()] == ["a"]
    got = tasks.resolved_inputs(spark.createDataFrame([("s", ["s--v000", "s--v001"])], "site_id string, sample_ids array<string>"), spark.createDataFrame([("s--v001",)], "sample_id string"), spark.createDataFrame([("s", 1, "k")], "site_id string, variant int, stratum string"))
    assert [tuple(r) for r in got.collect()] == [("s", 1, "s--v001", "k")]
    rel = tasks.release_state(spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "name string, sha256 string, records int"), spark.createDataFrame([("a", "x", 3)], "name string, sha256 string, records int"))
    assert {tuple(r) for r in rel.collect()} == {("a", "count"), ("b", "missing")}
    assert ask(tasks.observed({"a": F.lit(None).cast("string"), "b": F.lit(1)})) and not ask(tasks.observed({"a": F.lit(None).cast("string")}))


def test_browsing(spark):
    sc = spark.createDataFrame([("s", "c", [("goto", 404), ("click", 500)])], "site_id string, scenario_id string, steps array<struct<op:string,status:int>>")
    resp = spark.createDataFrame([("s", "c", "http://l/x%20y.png", 403, "image"), ("s", "c", "http://l/f.woff", 410, "font"), ("s", "c", "http://l/api", 500, "fetch")], "site_id string, scenario_id string, url string, status int, resource_type string")
    assets = spark.createDataFrame([("s", "/x y.png", 403)], "site_id string, out_rel string, status int")
    deg = browsing.degraded_responses(resp, assets)
    assert {r.status: r.degraded for r in deg.collect()} == {403: True, 410: False, 500: False}
    texts = ["status of 404 ()", "status of 403", "status of 410", "status of 500", "https://fonts.gstatic.com/x failed", "Refused to load: Content Security Policy", "boom"]
    msg = spark.createDataFrame([("s", "c", t) for t in texts], "site_id string, scenario_id string, message string")
    assert {r.message for r in browsing.unexpected_console_errors(msg, sc, deg).collect()} == {"status of 500", "boom"}
    assert {r.message for r in browsing.unexpected_page_errors(msg, msg.where("message <> 'boom'")).collect()} == {"boom"}
    one = spark.createDataFrame([("http://l/a?x", 200, "GET", "fetch"), ("http://other/a", 200, "GET", "fetch")], "url string, status int, method string, resource_type string")
    assert [r.path for r in browsing.response_events(one, F.lit("http://l")).collect()] == ["/a", "[EXTERNAL]"]
    null = F.lit(None).cast("string")
    assert [r[0] for r in one.select(browsing.response_matches(F.col("url"), F.col("status"), F.col("method"), F.lit("/a"), F.lit(200), null)).collect()] == [True, True]
