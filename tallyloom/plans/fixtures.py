"""Small invented inputs in the shapes of the record formats."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession

from tallyloom.operators import evidence

GOLD = "sample_id string, site_id string, platform string, intent string, entry_value string, obfuscation_types array<string>, messages array<struct<message_id:string,text:string>>"
PREDICTION = "sample_id string, input_view string, platform string, intent string, abstain boolean, messages array<struct<message_id:string,text:string>>, candidates array<struct<rank:int,value:string,confidence:double>>"


def gold(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([
        ("s1--v000", "s1", "chat", "Ask  to log in", "https://one.test/a", ["swap", "layout"], [("m1", "please open one.test/a now"), ("m2", "你好 world")]),
        ("s2--v000", "s2", "mail", "offer", "two.example", ["swap"], [("m1", "a")]),
        ("s3--v000", "s3", "chat", "offer", "[MASKED_SITE_A]", [], []),
    ], GOLD)


def predictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([
        ("s1--v000", "text", "chat", "ask to LOG in", False, [("m1", "please  open one.test/a now"), ("m2", "你们 world")], [(2, "HTTPS://One.test:443/a", 0.4), (1, "one.invalid", 0.6)]),
        ("s2--v000", "text", "mail", "offer", False, [("m1", "abcde")], [(1, "https://two.example/", 0.9), (2, "http://evil.example.co/", 0.1)]),
    ], PREDICTION)


PAIRED = "model string, ordinal int, task2_case_ref string, gold_decision string, gold_type string, web_pred_decision string, web_pred_type string, gate_pass boolean, gated_pred_decision string, gated_pred_type string"


def paired(spark: SparkSession, models: int = 2, sites: int = 12) -> DataFrame:
    d, t = ("VIOLATION", "NON_VIOLATION", "INSUFFICIENT_EVIDENCE"), ("A", "B")
    rows = []
    for m in range(models):
        for i in range(sites):
            gd, wd = d[i % 3], d[(i + (i % 4 == m)) % 3]
            gt, wt, gate = (t[i % 2] if gd == d[0] else "NONE"), (t[(i + m) % 2] if wd == d[0] else "NONE"), i % 5 != m
            rows.append((f"model{m}", i, f"case{i}", gd, gt, wd, wt, gate, wd if gate else "__BOTTOM__", wt if gate else "__BOTTOM__"))
    return spark.createDataFrame(rows, PAIRED)


def case(**changes) -> dict:
    """An admissible case; changes replace whole sections."""
    body = {
        "case_id": "c1", "scope": {"decision_level": "risk"}, "decision_policy": {"min_independent_support_groups": 2}, "evidence_gate": {g: True for g in evidence.GATES},
        "provenance": {
            "agents": [{"id": "AG1"}],
            "activities": [{"id": "ACT1", "agent_ids": ["AG1"], "used_entity_ids": [], "generated_entity_ids": ["ART1", "ART2"], "started_at": "2026-01-01T00:00:00Z", "ended_at": "2026-01-01T01:00:00Z"},
                           {"id": "ACT2", "agent_ids": ["AG1"], "used_entity_ids": ["ART1"], "generated_entity_ids": ["ART3"], "started_at": "2026-01-01T02:00:00Z", "ended_at": "2026-01-01T03:00:00Z"}],
            "entities": [{"id": f"ART{i}", "path": f"a/{i}.txt", "sha256": "0" * 64, "source_stage": "source_capture", "primary_source": i < 3} for i in (1, 2, 3)],
            "derivations": [{"id": "DER1", "generated_entity_id": "ART3", "used_entity_ids": ["ART1"], "activity_id": "ACT2"}],
        },
        "search_scopes": [{"id": "SS1", "coverage_status": "COMPLETE", "planned_actions": 2, "completed_actions": 2, "completion_basis": "all pages", "evidence_ids": ["E1"]}],
        "dependency_groups": [{"id": "DG1", "root_entity_ids": ["ART1"], "member_observation_ids": ["E1"]}, {"id": "DG2", "root_entity_ids": ["ART2"], "member_observation_ids": ["E2"]}],
        "observations": [{"id": "E1", "polarity": "PRESENT", "entity_id": "ART3", "activity_id": "ACT2", "dependency_group_id": "DG1", "search_scope_ids": ["SS1"]},
                         {"id": "E2", "polarity": "ABSENCE", "entity_id": "ART2", "activity_id": "ACT1", "dependency_group_id": "DG2", "search_scope_ids": ["SS1"]}],
        "inferences": [{"id": "I1", "based_on_ids": ["E1", "E2"], "agent_id": "AG1"}],
        "proposition_set": {"propositions": [{"id": "H1", "role": "TARGET", "risk_alignment": "HIGH_RISK", "level": "risk", "mutually_exclusive_with": ["H2"]}, {"id": "H2", "role": "ALTERNATIVE", "risk_alignment": "BENIGN", "level": "risk", "mutually_exclusive_with": ["H1"]}]},
        "predictions": [{"id": "PRED1", "proposition_id": "H1", "search_scope_ids": ["SS1"]}, {"id": "PRED2", "proposition_id": "H2", "search_scope_ids": []}],
        "alternative_explanations": [{"id": "ALT1", "materiality": "MATERIAL", "status": "REFUTED", "related_proposition_ids": ["H2"], "evidence_ids": ["E1"], "search_scope_ids": []}],
        "assessments": [{"id": "ASMT1", "subject_id": "I1", "proposition_id": "H1", "prediction_id": "PRED1", "direction": "SUPPORTS", "strength": "HIGH", "alternative_explanation_ids": ["ALT1"]},
                        {"id": "ASMT2", "subject_id": "E1", "proposition_id": "H2", "prediction_id": "PRED2", "direction": "REFUTES", "strength": "LOW", "alternative_explanation_ids": []}],
        "conclusion": {"outcome": "SUPPORTED_HIGH_RISK", "selected_proposition_id": "H1", "supporting_assessment_ids": ["ASMT1"], "counter_assessment_ids": [], "unresolved_alternative_ids": [], "requires_human_review": False},
        "stopping": {"decision": "STOP_SUFFICIENT", "unmet_prediction_ids": [], "unresolved_alternative_ids": []},
    }
    return body | changes


def cases(spark: SparkSession, bodies: list[dict]) -> DataFrame:
    text = spark.createDataFrame([Row(value=json.dumps(b)) for b in bodies])
    from pyspark.sql import functions as F

    return text.select(F.from_json("value", evidence.SCHEMA).alias("c")).select("c.*")


def broken_cases() -> list[dict]:
    """One admissible case and some that break one rule or several."""
    base = case()
    swap = lambda section, i, **kv: [dict(r, **kv) if n == i else r for n, r in enumerate(base[section])]
    return [
        base, {"case_id": "empty"},
        case(case_id="gate", evidence_gate={**base["evidence_gate"], "integrity_verified": False}),
        case(case_id="cycle", inferences=[{"id": "I1", "based_on_ids": ["E1", "I2"], "agent_id": "AG1"}, {"id": "I2", "based_on_ids": ["I1"], "agent_id": "AG9"}]),
        case(case_id="scope", search_scopes=[{**base["search_scopes"][0], "coverage_status": "PARTIAL"}]),
        case(case_id="rival", assessments=[*base["assessments"], {"id": "ASMT3", "subject_id": "I1", "proposition_id": "H2", "prediction_id": "PRED2", "direction": "SUPPORTS", "strength": "MODERATE", "alternative_explanation_ids": []}]),
        case(case_id="open", alternative_explanations=swap("alternative_explanations", 0, status="UNRESOLVED")),
        case(case_id="groups", decision_policy={"min_independent_support_groups": 3}),
        case(case_id="twice", observations=[*base["observations"], base["observations"][0]]),
    ]
