import json

import pytest

from tallyloom.__main__ import main
from tallyloom.operators.scoring import BOTTOM

from .test_run_checks import SCHEMA, TEXT_BREAKS, sha, text_run


def put(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def out(path):
    return [json.loads(line) for p in sorted(path.glob("part*")) for line in p.read_text().splitlines()]


def test_score(spark, tmp_path):
    gold = [{"sample_id": s, "site_id": "x", "platform": "qq", "intent": "Go", "entry_value": "https://a.test/", "obfuscation_types": ["t"], "messages": [{"message_id": "m", "text": "abcd"}]} for s in "ab"]
    told = [{"sample_id": "a", "input_view": "T", "platform": "qq", "intent": "go", "abstain": False, "messages": [{"message_id": "m", "text": "abxd"}], "candidates": [{"rank": 1, "value": "HTTPS://A.test", "confidence": 1.0}]}]
    args = ["score", "--gold", put(tmp_path / "g", gold), "--predictions", put(tmp_path / "p", told), "--out", str(tmp_path / "out")]
    with pytest.raises(Exception, match="missing prediction: b"):
        main(args)
    args[-1] = str(tmp_path / "out2")
    assert main([*args, "--allow-missing"]) == 0
    rows = {(r["scope"], r["value"]): r for r in out(tmp_path / "out2")}
    assert set(rows) == {("overall", None), ("platform", "qq"), ("obfuscation_type", "t")}
    assert rows["overall", None]["character_error_rate"] == 5 / 8 and rows["overall", None]["entry_top1_exact_rate"] == 0.5
    with pytest.raises(Exception, match="exists"):
        main([*args, "--allow-missing"])


def test_bootstrap(spark, tmp_path):
    rows = [{"model": m, "ordinal": i, "task2_case_ref": f"c{i}", "gold_decision": "VIOLATION" if i % 2 else "NON_VIOLATION", "gold_type": "A" if i % 2 else "NONE", "web_pred_decision": "VIOLATION", "web_pred_type": "A", "gate_pass": i > 2, "gated_pred_decision": "VIOLATION" if i > 2 else BOTTOM, "gated_pred_type": "A" if i > 2 else BOTTOM} for m in ("m1", "m2") for i in range(8)]
    assert main(["bootstrap", "--cases", put(tmp_path / "c", rows), "--replicates", "20", "--out", str(tmp_path / "out")]) == 0
    got = {(r["model"], r["metric"]): r for r in out(tmp_path / "out")}
    assert len(got) == 20 and got["m1", "web_decision_accuracy"]["point"] == 0.5 and got["m2", "gate_loss"]["ci_low"] <= got["m2", "gate_loss"]["ci_high"]
    with pytest.raises(SystemExit, match="lack or repeat: 3"):
        main(["bootstrap", "--cases", put(tmp_path / "d", rows[:3] + rows[4:]), "--out", str(tmp_path / "no")])


def test_check_runs_and_schema(spark, tmp_path):
    files, lines = [], []
    for run, content in (("good", text_run()), ("bad", text_run(TEXT_BREAKS["SUMMARY_NOT_PASS"][0]))):
        for path, text in content.items():
            files.append({"run_id": run, "path": path, "sha256": sha(text), "text": text if path.endswith(".json") else None})
            lines += [{"run_id": run, "path": path, "line_no": i, "text": t} for i, t in enumerate(text.splitlines())] if path.endswith(".jsonl") else []
    (tmp_path / "schema.json").write_text(json.dumps(SCHEMA))
    args = ["check-runs", "--files", put(tmp_path / "f", files), "--lines", put(tmp_path / "l", lines), "--schema", str(tmp_path / "schema.json"), "--out", str(tmp_path / "out")]
    assert main(args) == 1
    assert [(r["run_id"], r["code"]) for r in out(tmp_path / "out/findings")] == [("bad", "SUMMARY_NOT_PASS")]
    assert {r["run_id"]: r["status"] for r in out(tmp_path / "out/verdicts")} == {"good": "PASS", "bad": "FAIL"}
    assert main(["schema", "--schema", str(tmp_path / "schema.json"), "--records", put(tmp_path / "r", [{"sample_id": 1}]), "--out", str(tmp_path / "e")]) == 1
    assert sorted(r["detail"] for r in out(tmp_path / "e")) == ["entry_candidates", "platform", "reconstructed_messages"]
