"""Every check of a run: one run in order, and one broken run for each code."""

import copy
import hashlib
import json

import pytest

from tallyloom.operators.run_checks import findings, smoke_checks, text_batch_checks, verdicts

SCHEMA = {
    "type": "object",
    "required": ["sample_id", "platform", "entry_candidates", "reconstructed_messages"],
    "properties": {"entry_candidates": {"type": "array", "items": {"required": ["rank", "value"]}}, "abstain": {"type": "boolean"}},
}
POLICY = {"temperature_policy": "explicit_zero", "reasoning_effort_policy": "explicit_minimal", "model_request_options": {"temperature": 0, "reasoning_effort": "minimal"}}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def lines(rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def text_run(change=lambda stage, x: None):
    """path: content. change(stage, value) may alter each record before the digests of what holds it are made."""
    tasks = [{"sample_id": f"s{n}--v{v:03d}", "platform": "qq", "task_sha256": sha(f"{n}{v}")} for n in range(4) for v in range(2)]
    chosen = [t for t in tasks if t["sample_id"][1] in "12" and t["sample_id"].endswith("1")]
    files = {"in/tasks.jsonl": lines(tasks), "in/schema.json": json.dumps(SCHEMA)}
    config = {
        "schema_version": "task1-text-batch-config/v0.1", "input_view": "TOKEN_TEXT", "oneapi_used": False, "requested_model": "m1", "created_at": "now", "source_offset": 1, "source_limit": 2, "variant_indices": [1],
        "selected_task_count": 2, "selected_source_count": 2, "selected_task_order_sha256": sha(canonical([t["task_sha256"] for t in chosen])), "rate": 1.0, "é": [1e16, {"b": 1, "a": None}],
        "files": {"tasks": {"path": "in/tasks.jsonl", "sha256": sha(files["in/tasks.jsonl"])}, "prediction_schema": {"path": "in/schema.json", "sha256": sha(files["in/schema.json"])}},
    }
    change("config", config)
    config.setdefault("config_fingerprint", sha(canonical({k: v for k, v in config.items() if k != "created_at"})))
    files["config.json"] = json.dumps(config)
    predictions = []
    for task in chosen:
        root = f"tasks/{task['sample_id']}"
        prediction = {"sample_id": task["sample_id"], "platform": "qq", "entry_candidates": [{"rank": 1, "value": "a.example.com"}], "reconstructed_messages": [{"message_id": "m1"}]}
        call = {"status": "PASS", "requested_model": "m1", "response_model": "m1", "request_protocol": "task1_text_batch_v0.1", "multimodal_input": False, "image_count": 0, **copy.deepcopy(POLICY), "attempts": [{"status": "FAIL", "request_sha256": sha("q")}, {"status": "PASS", "request_sha256": sha("q"), "response_content": "r", "response_sha256": sha("r")}]}
        audit = {"status": "PASS", "forbidden_key_findings": [], "gold_present": False, "resolver_present": False, "web_evidence_present": False, "image": {}}
        for stage, value in (("prediction", prediction), ("call", call), ("audit", audit)):
            if task is chosen[0]:
                change(stage, value)
        predictions.append(copy.deepcopy(prediction))
        state = {"status": "PASS", "config_fingerprint": config["config_fingerprint"], "prediction_sha256": sha(json.dumps(prediction)), "attempt_path": f"{root}/attempts/./1/../1", "model_call_sha256": sha(json.dumps(call))}
        if task is chosen[0]:
            change("state", state)
        files |= {f"{root}/state.json": json.dumps(state), f"{root}/prediction.json": json.dumps(prediction), f"{root}/attempts/1/input_audit.json": json.dumps(audit), f"{root}/attempts/1/model_call.json": json.dumps(call)}
    change("predictions", predictions)
    files |= {"predictions.jsonl": lines(predictions), "failures.jsonl": ""}
    summary = {"status": "PASS", "oneapi_used": False, "config_fingerprint": config["config_fingerprint"], "predictions_sha256": sha(files["predictions.jsonl"]), "failures_sha256": sha("")}
    change("summary", summary)
    summary.setdefault("summary_sha256", sha(canonical(summary)))
    files["summary.json"] = json.dumps(summary)
    change("files", files)
    return files


def put(stage, **values):
    return lambda at, x: x.update(copy.deepcopy(values)) if at == stage else None


def on(stage, act):
    return lambda at, x: act(x) if at == stage else None


ONE = "tasks/s1--v001"
#: code: (what breaks it, other codes that then follow).
TEXT_BREAKS = {
    "CONFIG_FINGERPRINT_MISMATCH": (put("config", config_fingerprint="x"), ()),
    "SUMMARY_NOT_PASS": (put("summary", status="FAIL"), ()),
    "SUMMARY_ONEAPI_USED": (put("summary", oneapi_used=None), ()),
    "CONFIG_ONEAPI_USED": (put("config", oneapi_used=True), ()),
    "CONFIG_SCHEMA_NOT_TEXT": (put("config", schema_version="v2"), ()),
    "CONFIG_INPUT_VIEW_NOT_TOKEN_TEXT": (put("config", input_view="IMAGE"), ()),
    "SUMMARY_CONFIG_MISMATCH": (put("summary", config_fingerprint="x"), ()),
    "SUMMARY_HASH_MISMATCH": (put("summary", summary_sha256="x"), ()),
    "CONFIG_FILE_RECORD_INVALID": (on("config", lambda c: c["files"].update(extra=[])), ()),
    "CONFIG_EXTRA_MISSING": (on("config", lambda c: c["files"].update(extra={"path": "no", "sha256": ""})), ()),
    "CONFIG_TASKS_HASH_MISMATCH": (on("config", lambda c: c["files"]["tasks"].update(sha256="x")), ()),
    "SELECTED_TASK_COUNT_MISMATCH": (put("config", selected_task_count=3), ()),
    "SELECTED_SOURCE_COUNT_MISMATCH": (put("config", selected_source_count=True), ()),
    "SELECTED_TASK_ORDER_HASH_MISMATCH": (put("config", selected_task_order_sha256=None), ()),
    "AGGREGATE_PREDICTION_COUNT_MISMATCH": (on("predictions", lambda p: p.append({"sample_id": "other"})), ()),
    "AGGREGATE_PREDICTION_DUPLICATE": (on("predictions", lambda p: p.append(p[0])), ("AGGREGATE_PREDICTION_COUNT_MISMATCH",)),
    "AGGREGATE_PREDICTIONS_MISSING": (on("files", lambda f: f.pop("predictions.jsonl")), ("AGGREGATE_PREDICTION_COUNT_MISMATCH", "AGGREGATE_PREDICTION_CONTENT_MISMATCH")),
    "AGGREGATE_PREDICTIONS_HASH_MISMATCH": (put("summary", predictions_sha256="x"), ()),
    "AGGREGATE_FAILURES_MISSING": (on("files", lambda f: f.pop("failures.jsonl")), ()),
    "AGGREGATE_FAILURES_HASH_MISMATCH": (put("summary", failures_sha256=None), ()),
    "FAILURE_LEDGER_NONEMPTY": (on("files", lambda f: f.update({"failures.jsonl": "\n{}\n"})), ("AGGREGATE_FAILURES_HASH_MISMATCH",)),
    "TASK_STATE_MISSING": (on("files", lambda f: f.pop(f"{ONE}/state.json")), ()),
    "TASK_PREDICTION_MISSING": (on("files", lambda f: f.pop(f"{ONE}/prediction.json")), ()),
    "TASK_STATE_NOT_PASS": (put("state", status="RUNNING"), ()),
    "TASK_CONFIG_MISMATCH": (put("state", config_fingerprint=None), ()),
    "TASK_PREDICTION_HASH_MISMATCH": (put("state", prediction_sha256="x"), ()),
    "TASK_PREDICTION_SCHEMA_INVALID": (put("prediction", abstain="no"), ("TASK_PREDICTION_SEMANTICS_INVALID",)),
    "TASK_PREDICTION_SEMANTICS_INVALID": (put("prediction", entry_candidates=[{"rank": 1, "value": "live.com"}]), ()),
    "AGGREGATE_PREDICTION_CONTENT_MISMATCH": (on("predictions", lambda p: p[0].update(abstain=True)), ()),
    "ATTEMPT_PATH_ESCAPES_TASK": (put("state", attempt_path=f"{ONE}/../s2--v001/attempts/1"), ()),
    "INPUT_AUDIT_MISSING": (on("files", lambda f: f.pop(f"{ONE}/attempts/1/input_audit.json")), ()),
    "MODEL_CALL_MISSING": (on("files", lambda f: f.pop(f"{ONE}/attempts/1/model_call.json")), ()),
    "MODEL_CALL_HASH_MISMATCH": (put("state", model_call_sha256="x"), ()),
    "INPUT_AUDIT_NOT_PASS": (put("audit", status="FAIL"), ()),
    "INPUT_FORBIDDEN_KEY_LEAK": (put("audit", forbidden_key_findings=["$.gold"]), ()),
    "INPUT_GOLD_PRESENT": (put("audit", gold_present=True), ()),
    "INPUT_RESOLVER_PRESENT": (put("audit", resolver_present=0), ()),
    "INPUT_WEB_EVIDENCE_PRESENT": (on("audit", lambda a: a.pop("web_evidence_present")), ()),
    "TASK_IMAGE_MISSING": (put("audit", image={"path": "no.png"}), ()),
    "TASK_IMAGE_HASH_MISMATCH": (put("audit", image={"path": "config.json", "sha256": "x"}), ()),
    "MODEL_CALL_NOT_PASS": (put("call", status=None), ()),
    "REQUESTED_MODEL_CHANGED": (put("call", requested_model="m2"), ()),
    "RESOLVED_MODEL_CHANGED": (put("call", response_model="m2"), ()),
    "REQUEST_PROTOCOL_CHANGED": (put("call", request_protocol="x"), ()),
    "MODEL_CALL_UNEXPECTED_MULTIMODAL_INPUT": (put("call", multimodal_input=True), ()),
    "MODEL_CALL_UNEXPECTED_IMAGE": (put("call", image_count=1), ()),
    "GENERATION_POLICY_INVALID": (put("call", thinking_policy="x", model_request_options={"temperature": 1, "enable_thinking": False}), ()),
    "MODEL_ATTEMPTS_EMPTY": (put("call", attempts=[]), ("MODEL_FINAL_ATTEMPT_NOT_PASS",)),
    "MODEL_FINAL_ATTEMPT_NOT_PASS": (on("call", lambda c: c["attempts"].reverse()), ()),
    "MODEL_REQUEST_HASH_INVALID": (on("call", lambda c: c["attempts"][0].update(request_sha256="Q")), ()),
    "MODEL_RESPONSE_HASH_MISMATCH": (on("call", lambda c: c["attempts"][1].update(response_content="other")), ()),
}


def smoke_run(change=lambda stage, x: None):
    files = {"img/task.png": "T", "img/raw1.png": "R1", "img/raw2.png": "R2", "img/seen1.png": "S1", "img/seen2.png": "S2"}
    task = {"sample_id": "x--v001", "messages": [{"content": "hello"}, {"content": None}, {"content": "wörld"}]}
    confusables = {"mapping_id": "map", "unicode_version": "15"}
    profile = {"verification": {"scenarios": [{"id": "other", "steps": []}, {"id": "sc", "steps": [{"op": "goto"}, {"op": "click"}, {"op": "expect_text"}]}]}}
    resolver = {"bindings": [{"site_id": "site", "case_ref": "case-1", "sample_ids": ["x--v000", "x--v001"], "entry_value_sha256": sha("entry"), "profile": {"path": "profile.json"}}]}
    probe = {"results": [{"model": "kimi-1", "status": "PASS_MULTIMODAL_ROUTE", "probes": [{"response_model": "kimi-1-x"}, {"response_model": ""}]}, {"model": "kimi-1", "status": "FAIL"}]}
    for stage, value in (("task", task), ("probe", probe)):
        change(stage, value)
    files |= {"tasks.jsonl": lines([{"sample_id": "x--v000"}, task]), "confusables.json": json.dumps(confusables), "profile.json": json.dumps(profile), "resolver.json": json.dumps(resolver), "cases.json": json.dumps({"cases": [{"site_id": "site", "variant_index": 1, "scenario_id": "sc"}]}), "route_probe.json": json.dumps(probe)}
    evidence = []
    for i in (1, 2):
        audit = {"status": "PASS", "post_redaction_sensitive_count": 0, "derived": {"path": f"img/./seen{i}.png", "sha256": sha(f"S{i}")}, "parent": {"path": f"img/raw{i}.png", "sha256": sha(f"R{i}")}}
        if i == 1:
            change("audit", audit)
        files[f"audit{i}.json"] = json.dumps(audit)
        evidence.append({"evidence_id": f"E{i}", "redaction_status": "PASS", "model_visible_path": f"img/seen{i}.png", "model_visible_sha256": sha(f"S{i}"), "parent_sha256": sha(f"R{i}"), "redaction_audit_path": f"audit{i}.json"})
    call = lambda phase, n: {"phase": phase, "status": "PASS", "requested_model": "kimi-1", "response_model": "kimi-1-x", "multimodal_input": True, "image_count": n, "images": [{"evidence_id": f"E{i}", "path": f"img/seen{i}.png", "sha256": sha(f"S{i}")} for i in range(1, n + 1)], "attempts": [{"response_model": None}, {"response_model": "kimi-1-x"}], "temperature_policy": "explicit_zero", "reasoning_effort_policy": "explicit_minimal", "thinking_policy": "thinking_type_disabled", "model_request_options": {"temperature": 0, "reasoning_effort": "minimal", "thinking": {"type": "disabled"}}}
    result = {
        "status": "PASS", "sample_id": "x--v001", "requested_model": "kimi-1", "resolved_models": ["kimi-1-x"],
        "entry_reconstruction": {
            "status": "PASS", "setting": "TAXONOMY_AWARE", "input_view": "MULTIMODAL", "top1_exact_match": True, "predicted_entry_sha256": sha("entry"), "expected_entry_sha256": sha("entry"), "message_token_text_sha256": sha("hello\n\n\n\nwörld"),
            "confusable_legend": {"setting": "TAXONOMY_AWARE", **confusables, "mapping_file_sha256": sha(files["confusables.json"])}, "task_image": {"path": "img/task.png", "sha256": sha("T")},
        },
        "browser_execution": {"status": "PASS", "scenario_id": "sc", "action_count": 1, "scenario_assertions_passed": 1, "external_request_attempt_count": 0, "external_request_attempt_sha256s": [], "actions": [{"status": "EXECUTED"}]},
        "evidence": evidence, "model_calls": [call("task1", 1), call("action", 1), call("final_judge", 2)],
        "judgment": {"intent": "i", "evidence": [{"evidence_id": "E1", "observation": "o"}], "risk_reason": "r", "answer": "YES", "evidence_sufficiency": "SUFFICIENT", "counterevidence": []},
        "judgment_status": "PROTOCOL_VALID_UNSCORED_NO_HUMAN_GOLD", "claim_boundary": {"full_corpus_model_evaluation": False, "accuracy_or_f1_allowed": False, "human_gold_present": False},
    }
    change("result", result)
    files["cases/case-1/case_result.json"] = json.dumps(result)
    summary = {
        "status": "PASS", "transport": "libinfer-neo", "oneapi_used": False, "requested_model": "kimi-1", "target_case_count": 1, "pass_case_count": 1, "fail_case_count": 0, "case_results": [{"case_ref": "case-1"}],
        "claim_boundary": {"scale_600_model_evaluation_status": "NOT_RUN", "fraud_accuracy_f1_allowed": False, "human_gold_present": False, "judgments_are_protocol_valid_but_unscored": True},
    }
    change("summary", summary)
    files["summary.json"] = json.dumps(summary)
    change("files", files)
    return files


def entry(**values):
    return on("result", lambda r: r["entry_reconstruction"].update(values))


def legend(**values):
    return on("result", lambda r: r["entry_reconstruction"]["confusable_legend"].update(values))


def browser(**values):
    return on("result", lambda r: r["browser_execution"].update(values))


def shot(**values):
    return on("result", lambda r: r["evidence"][0].update(values))


def claim(**values):
    return on("result", lambda r: r["claim_boundary"].update(values))


def call(n, **values):
    return on("result", lambda r: r["model_calls"][n].update(values))


SMOKE_BREAKS = {
    "SUMMARY_NOT_PASS": (put("summary", status=None), ()),
    "TRANSPORT_NOT_LIBINFER_NEO": (put("summary", transport="http"), ()),
    "ONEAPI_NOT_DISABLED": (put("summary", oneapi_used=True), ()),
    "MODEL_NOT_FROZEN_ROUTE": (on("probe", lambda p: p["results"].append(p["results"][0])), ()),
    "ROUTE_RESOLUTION_NOT_SINGLE": (on("probe", lambda p: p["results"][0]["probes"].append({"response_model": "y"})), ("CASE_RESOLVED_MODEL_MISMATCH",)),
    "TARGET_COUNT_MISMATCH": (put("summary", target_case_count=2), ()),
    "PASS_COUNT_MISMATCH": (put("summary", pass_case_count="1"), ()),
    "FAIL_COUNT_NONZERO": (put("summary", fail_case_count=1), ()),
    "FULL_600_MODEL_CLAIM_PRESENT": (on("summary", lambda s: s["claim_boundary"].update(scale_600_model_evaluation_status="DONE")), ()),
    "METRIC_CLAIM_ALLOWED": (on("summary", lambda s: s["claim_boundary"].update(fraud_accuracy_f1_allowed=True)), ()),
    "HUMAN_GOLD_MISSTATED": (on("summary", lambda s: s["claim_boundary"].update(human_gold_present=True)), ()),
    "UNSCORED_BOUNDARY_MISSING": (on("summary", lambda s: s["claim_boundary"].pop("judgments_are_protocol_valid_but_unscored")), ()),
    "SUMMARY_CASE_SET_MISMATCH": (on("summary", lambda s: s["case_results"].append({"case_ref": "case-2"})), ()),
    "CASE_RESULT_MISSING": (on("files", lambda f: f.pop("cases/case-1/case_result.json")), ()),
    "CASE_NOT_PASS": (put("result", status="FAIL"), ()),
    "SAMPLE_ID_MISMATCH": (put("result", sample_id="x--v000"), ()),
    "CASE_MODEL_MISMATCH": (put("result", requested_model="m"), ()),
    "CASE_RESOLVED_MODEL_MISMATCH": (put("result", resolved_models=["kimi-1-x", "y"]), ()),
    "ENTRY_NOT_PASS": (entry(status="FAIL"), ()),
    "ENTRY_SETTING_INVALID": (entry(setting="x"), ()),
    "ENTRY_VIEW_NOT_MULTIMODAL": (entry(input_view="TOKEN_TEXT"), ()),
    "ENTRY_TOP1_NOT_EXACT": (entry(top1_exact_match=None), ()),
    "ENTRY_PREDICTION_HASH_MISMATCH": (entry(predicted_entry_sha256="x"), ()),
    "ENTRY_GOLD_HASH_MISMATCH": (entry(expected_entry_sha256="x"), ()),
    "ENTRY_TEXT_HASH_MISMATCH": (on("task", lambda t: t["messages"].pop()), ()),
    "LEGEND_SETTING_INVALID": (legend(setting="x"), ()),
    "LEGEND_MAPPING_ID_MISMATCH": (legend(mapping_id=None), ()),
    "LEGEND_UNICODE_VERSION_MISMATCH": (legend(unicode_version="14"), ()),
    "LEGEND_FILE_HASH_MISMATCH": (legend(mapping_file_sha256="x"), ()),
    "TASK_IMAGE_MISSING": (entry(task_image=None), ()),
    "TASK_IMAGE_HASH_MISMATCH": (entry(task_image={"path": "img/task.png"}), ()),
    "BROWSER_NOT_PASS": (browser(status="FAIL"), ()),
    "SCENARIO_ID_MISMATCH": (browser(scenario_id="other"), ()),
    "ACTION_COUNT_MISMATCH": (browser(action_count=2), ()),
    "ASSERTION_COUNT_MISMATCH": (browser(scenario_assertions_passed=0), ()),
    "EXTERNAL_REQUEST_ATTEMPTED": (browser(external_request_attempt_count=1), ()),
    "EXTERNAL_REQUEST_LEDGER_NONEMPTY": (browser(external_request_attempt_sha256s=["x"]), ()),
    "ACTION_NOT_EXECUTED": (browser(actions=[{"status": "SKIPPED"}]), ()),
    "EVIDENCE_COUNT_MISMATCH": (on("result", lambda r: (r["evidence"].pop(), r["model_calls"][2].update(images=r["model_calls"][2]["images"][:1], image_count=1))), ()),
    "EVIDENCE_ID_DUPLICATE": (on("result", lambda r: (r["evidence"][1].update(evidence_id="E1"), r["model_calls"][2].update(images=r["model_calls"][2]["images"][:1], image_count=1))), ()),
    "REDACTION_NOT_PASS": (shot(redaction_status="FAIL"), ()),
    "MODEL_VISIBLE_IMAGE_MISSING": (shot(model_visible_path="no.png"), ()),
    "MODEL_VISIBLE_IMAGE_HASH_MISMATCH": (shot(model_visible_sha256="x"), ("REDACTION_DERIVED_HASH_MISMATCH",)),
    "REDACTION_AUDIT_MISSING": (on("files", lambda f: f.pop("audit1.json")), ()),
    "REDACTION_AUDIT_NOT_PASS": (put("audit", status="FAIL"), ()),
    "POST_REDACTION_LEAK": (put("audit", post_redaction_sensitive_count=2), ()),
    "REDACTION_DERIVED_HASH_MISMATCH": (on("audit", lambda a: a["derived"].update(sha256="x")), ()),
    "REDACTION_PARENT_HASH_MISMATCH": (shot(parent_sha256="x"), ()),
    "REDACTION_DERIVED_PATH_MISMATCH": (on("audit", lambda a: a["derived"].update(path="img/seen2.png")), ()),
    "RAW_PARENT_IMAGE_MISSING": (on("audit", lambda a: a["parent"].update(path="no.png")), ()),
    "RAW_PARENT_IMAGE_HASH_MISMATCH": (on("audit", lambda a: a["parent"].update(path="img/raw2.png")), ()),
    "MODEL_CALL_COUNT_MISMATCH": (on("result", lambda r: r["model_calls"].pop(1)), ()),
    "TASK1_CALL_MISSING": (call(0, phase="action"), ()),
    "FINAL_JUDGE_CALL_MISSING": (on("result", lambda r: r["model_calls"].reverse()), ("TASK1_CALL_MISSING",)),
    "MODEL_CALL_NOT_PASS": (call(1, status="FAIL"), ()),
    "MODEL_CALL_REQUEST_CHANGED": (call(1, requested_model="m"), ()),
    "MODEL_CALL_RESOLUTION_CHANGED": (call(1, response_model=None), ()),
    "GENERATION_POLICY_INVALID": (call(1, model_request_options=[]), ()),
    "MODEL_CALL_NOT_MULTIMODAL": (call(1, multimodal_input=False), ()),
    "MODEL_CALL_IMAGE_COUNT_INVALID": (call(1, image_count=0, images=[]), ()),
    "MODEL_CALL_IMAGE_MISSING": (on("result", lambda r: r["model_calls"][1]["images"][0].update(path="no")), ()),
    "MODEL_CALL_IMAGE_HASH_MISMATCH": (on("result", lambda r: r["model_calls"][1]["images"][0].update(sha256="x")), ()),
    "MODEL_ATTEMPT_RESOLUTION_CHANGED": (call(1, attempts=[{"response_model": "y"}]), ()),
    "JUDGE_DID_NOT_RECEIVE_ALL_EVIDENCE": (on("result", lambda r: r["model_calls"][2].update(images=r["model_calls"][2]["images"][:1], image_count=1)), ()),
    "JUDGMENT_PROTOCOL_INVALID": (on("result", lambda r: r["judgment"].update(answer="MAYBE", evidence=[{"evidence_id": "E9"}, 1])), ()),
    "JUDGMENT_SCORE_BOUNDARY_INVALID": (put("result", judgment_status="SCORED"), ()),
    "CASE_FULL_CORPUS_CLAIM": (claim(full_corpus_model_evaluation=True), ()),
    "CASE_METRIC_CLAIM": (claim(accuracy_or_f1_allowed=None), ()),
    "CASE_HUMAN_GOLD_CLAIM": (claim(human_gold_present=True), ()),
}


def relations(spark, runs):
    files, rows = [], []
    for run, content in runs.items():
        for path, text in content.items():
            files.append((run, path, sha(text), text if path.endswith(".json") else None))
            rows += [(run, path, i, line) for i, line in enumerate(text.splitlines())] if path.endswith(".jsonl") else []
    return spark.createDataFrame(files, "run_id string, path string, sha256 string, text string").repartition(4), spark.createDataFrame(rows, "run_id string, path string, line_no long, text string").repartition(4)


@pytest.mark.parametrize("make, breaks, check, n_good", [(text_run, TEXT_BREAKS, lambda f, x: text_batch_checks(f, x, SCHEMA), 82), (smoke_run, SMOKE_BREAKS, smoke_checks, 100)])
def test_one_broken_run_for_each_code(spark, make, breaks, check, n_good):
    made = check(*relations(spark, {"good": make()} | {code: make(change) for code, (change, _) in breaks.items()})).cache()
    found = {}
    for r in findings(made).collect():
        found.setdefault(r.run_id, {}).setdefault(r.code, []).append((r.ref, r.detail))
    assert "good" not in found
    for code, (_, more) in breaks.items():
        assert set(found.get(code, {})) == {code, *more}, (code, found.get(code))
    by = {r.run_id: r for r in verdicts(made).collect()}
    assert (by["good"].status, by["good"].check_fail_count, by["good"].check_pass_count) == ("PASS", 0, n_good)
    assert all(by[code].status == "FAIL" for code in breaks)
    assert set(by) == {"good", *breaks}


def test_details(spark):
    changes = {"semantics": put("prediction", entry_candidates=[{"rank": 1, "value": "a.test"}, {"rank": 1, "value": "b.test"}]), "policy": put("call", model_request_options={"temperature": 0, "thinking": 1}, temperature_policy="x"), "schema": put("prediction", abstain=1)}
    got = {(r.run_id, r.code): (r.ref, r.detail) for r in findings(text_batch_checks(*relations(spark, {k: text_run(c) for k, c in changes.items()}), SCHEMA)).collect()}
    assert got[("semantics", "TASK_PREDICTION_SEMANTICS_INVALID")] == ("s1--v001", "duplicate entry candidate rank")
    assert got[("policy", "GENERATION_POLICY_INVALID")] == ("s1--v001", "TEMPERATURE_POLICY_NOT_FROZEN,REASONING_EFFORT_NOT_FROZEN,THINKING_OVERRIDE_UNEXPECTED")
    assert got[("schema", "TASK_PREDICTION_SCHEMA_INVALID")] == ("s1--v001", "abstain: type boolean")
    assert text_batch_checks(*relations(spark, {"none": {"summary.json": "{}"}}), SCHEMA).where("code = 'CONFIG_FINGERPRINT_MISMATCH' AND NOT ok").count() == 1
