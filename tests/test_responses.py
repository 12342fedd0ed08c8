import json

from pyspark.sql import functions as F

from tallyloom.operators import responses, tasks

ENTRY = "https://case-" + "0a" * 10 + ".test/start"
TASK1 = {"reconstructed_text": "t", "reconstructed_entry": ENTRY, "intent": "OPEN_SITE", "confidence": 0.5, "uncertainties": []}


def changed(base, **more):
    return {k: v for k, v in (base | more).items() if v is not ...}


def codes(spark, column, cases):
    df = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in cases.items()], "k string, raw string")
    return {r.k: r.x if not isinstance(r.x, list) else list(r.x) for r in df.select("k", column.alias("x")).collect()}


def test_task1_codes(spark):
    cases = {
        "good": TASK1, "no text": changed(TASK1, reconstructed_text=...), "true": changed(TASK1, confidence=True), "old": changed(TASK1, intent="OPEN_CONTROLLED_SITE_AND_INSPECT"), "upper": changed(TASK1, reconstructed_entry=ENTRY.upper()),
        "keys": changed(TASK1, more=1), "text": changed(TASK1, reconstructed_text=None), "intent": changed(TASK1, intent=["OPEN_SITE"]), "over": changed(TASK1, confidence=1.5), "string": changed(TASK1, confidence="0.5"),
        "doubts": changed(TASK1, uncertainties="x"), "entry": changed(TASK1, reconstructed_entry=ENTRY + "\n"), "none": "{", "list": "[]",
    }
    every = ["TASK1_CONFIDENCE_INVALID", "TASK1_INTENT_INVALID", "TASK1_KEYS_INVALID", "TASK1_RESERVED_ENTRY_GRAMMAR_INVALID", "TASK1_UNCERTAINTIES_INVALID"]
    assert codes(spark, responses.task1_codes(F.col("raw")), cases) == {
        "good": [], "no text": [], "true": [], "old": [], "upper": [], "keys": ["TASK1_KEYS_INVALID"], "text": ["TASK1_RECONSTRUCTED_TEXT_INVALID"], "intent": ["TASK1_INTENT_INVALID"], "over": ["TASK1_CONFIDENCE_INVALID"],
        "string": ["TASK1_CONFIDENCE_INVALID"], "doubts": ["TASK1_UNCERTAINTIES_INVALID"], "entry": ["TASK1_RESERVED_ENTRY_GRAMMAR_INVALID"], "none": every, "list": every,
    }


def test_judgment_shapes(spark):
    good = {"intent": "i", "evidence": [{"evidence_id": "E1", "observation": "o"}], "risk_reason": "r", "answer": "NO", "evidence_sufficiency": "SUFFICIENT", "counterevidence": []}
    cases = {
        "good": good, "keys": changed(good, intent=...), "answer": changed(good, answer=None), "enough": changed(good, evidence_sufficiency="x"), "reason": changed(good, risk_reason=" "), "list": changed(good, evidence={}), "empty": changed(good, evidence=[]),
        "item": changed(good, evidence=["E1", {"evidence_id": "E1"}, *good["evidence"]]), "unknown": changed(good, evidence=[{"evidence_id": "E9", "observation": ""}]), "counter": changed(good, counterevidence="x"),
    }
    assert codes(spark, responses.judgment_shape_codes(F.col("raw"), F.array(F.lit("E1"), F.lit("E2"))), cases) == {
        "good": [], "keys": ["JUDGMENT_KEYS_INVALID"], "answer": ["JUDGMENT_ANSWER_INVALID"], "enough": ["JUDGMENT_SUFFICIENCY_INVALID"], "reason": ["JUDGMENT_REASON_INVALID"], "list": ["JUDGMENT_EVIDENCE_INVALID"], "empty": ["JUDGMENT_EVIDENCE_EMPTY"],
        "item": ["JUDGMENT_EVIDENCE_ITEM_INVALID"], "unknown": ["JUDGMENT_EMPTY_OBSERVATION", "JUDGMENT_UNKNOWN_EVIDENCE_ID"], "counter": ["JUDGMENT_COUNTEREVIDENCE_INVALID"],
    }


def test_lenient_reading(spark):
    base = {"reconstructed_messages": [{"message_id": "m1", "text": "t"}], "entry_candidates": [{"entry": "a.test"}, {"value": "b.test", "confidence": 1}], "intent_label": "x", "platform": "qq", "abstain": False, "uncertainties": ["u"]}
    cases = {
        "good": base, "single": changed(base, reconstructed_messages=[], reconstructed_text="s"), "none": changed(base, entry_candidates=None), "lacks": changed(base, reconstructed_messages=...), "rows": changed(base, reconstructed_messages={"a": 1}),
        "row": changed(base, reconstructed_messages=["t"]), "ids": changed(base, reconstructed_messages=[{"message_id": 7, "text": "t"}]), "list": changed(base, entry_candidates="x"), "object": changed(base, entry_candidates=["x"]), "value": changed(base, entry_candidates=[{"value": 1, "entry": "a"}]),
        "share": changed(base, entry_candidates=[{"value": "a", "confidence": True}]), "six": changed(base, entry_candidates=[{"value": str(i)} for i in range(7)]), "intent": changed(base, intent=None), "platform": changed(base, platform="x"), "abstain": changed(base, abstain=0), "doubts": changed(base, uncertainties=[1]),
    }
    got = codes(spark, responses.lenient_reconstruction(F.col("raw"), F.array(F.lit("m1"))), cases)
    assert {k: r.failure for k, r in got.items()} == {
        "good": None, "single": None, "none": None, "six": None, "lacks": "response lacks reconstructed_messages or reconstructed_text", "rows": "reconstructed_messages is not a list", "row": "invalid reconstructed message",
        "ids": "reconstructed message IDs differ from the input", "list": "entry_candidates is not a list", "object": "entry candidate is not an object", "value": "entry candidate has no string value", "share": "entry candidate confidence is invalid",
        "intent": "intent is not a string", "platform": "platform is invalid", "abstain": "abstain is not a boolean", "doubts": "uncertainties is not a string array",
    }
    assert [tuple(c) for c in got["good"].candidates] == [("a.test", 1, 0.5), ("b.test", 2, 1.0)] and got["good"].intent == "x"
    assert [tuple(m) for m in got["single"].messages] == [("m1", "s")] and got["none"].candidates == [] and len(got["six"].candidates) == 5
    two = codes(spark, responses.lenient_reconstruction(F.col("raw"), F.array(F.lit("m1"), F.lit("m2"))), {"single": cases["single"]})
    assert two["single"].failure == "single reconstructed_text cannot represent multiple messages"


def test_items_of_other_keys(spark):
    t = spark.createDataFrame([(k, "CHAT", [("m1",)]) for k in "ab"], "sample_id string, platform string, messages array<struct<message_id:string>>")
    good = {"reconstructed_messages": [{"message_id": "m1", "text": "t"}], "intent_label": "OPEN_SITE", "platform": "CHAT", "entry_candidates": [{"rank": 1, "value": "one.test", "confidence": 0.9}], "abstain": False, "uncertainties": []}
    bad = changed(good, reconstructed_messages=[{"message_id": "m1", "text": "t", "note": 1}], entry_candidates=[{"rank": 1, "value": "one.test"}])
    got = {r.sample_id: list(r.codes) for r in tasks.response_codes(t, spark.createDataFrame([("a", json.dumps(good)), ("b", json.dumps(bad))], "sample_id string, raw string")).collect()}
    assert got == {"a": [], "b": ["ENTRY_CANDIDATE_RANKS_NOT_CONTIGUOUS", "ENTRY_CANDIDATE_SCHEMA_INVALID", "RECONSTRUCTED_MESSAGE_IDS_INVALID", "RECONSTRUCTED_MESSAGE_SCHEMA_INVALID"]}
