import json
import random

from pyspark.sql import functions as F

from tallyloom.functions.text import canonical_text
from tallyloom.operators import artifacts, state, transform


def test_paths_through_links(spark, tmp_path):
    """Against the file system itself."""
    root = tmp_path / "root"
    (root / "a/b").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    (root / "a/b/f.txt").write_text("f")
    (tmp_path / "out/g.txt").write_text("g")
    links = {"l1": "a/b", "a/up": "../a/b/f.txt", "a/b/away": "../../../out", "abs": f"{root}/a", "far": f"{tmp_path}/out/g.txt", "c1": "c2", "c2": "c1", "chain": "l1/f.txt", "dead": "nothing"}
    for name, target in links.items():
        (root / name).symlink_to(target)
    tree = [("a/b/f.txt", None, "AA")] + [(n, t, None) for n, t in links.items()]
    named = ["a/b/f.txt", "l1/f.txt", "a/up", "a/b/away/g.txt", "abs/b/f.txt", "far", "c1/x", "chain", "dead", "a/./b//f.txt", "no", "../x", "/etc/x", "a\\b", "abs/up"]
    entities = [("k", f"E{i}", p, "aa" if i % 2 == 0 else "bb") for i, p in enumerate(named)]
    got = {r.entity_id: r.state for r in artifacts.checked_artifacts(spark.createDataFrame(entities, "case_id string, entity_id string, path string, sha256 string"), spark.createDataFrame(tree, "path string, target string, sha256 string"), root=str(root)).collect()}
    want = {}
    for i, p in enumerate(named):
        if p.startswith("/") or ".." in p.split("/") or "\\" in p:
            continue
        try:
            real = (root / p).resolve()
        except (OSError, RuntimeError):
            real = root / "circle"
        inside = real.is_relative_to(root)
        want[f"E{i}"] = "escapes" if not inside else "missing" if not real.is_file() else "verified" if i % 2 == 0 else "mismatch"
    assert got == want and set(want.values()) == {"escapes", "missing", "verified", "mismatch"}
    states = spark.createDataFrame([("k", e, s) for e, s in got.items()], "case_id string, entity_id string, state string")
    counts = artifacts.artifact_counts(states).first()
    assert (counts.checked, counts.verified) == (sum(s != "escapes" for s in want.values()), sum(s == "verified" for s in want.values()))
    assert {r.code for r in artifacts.artifact_errors(states).collect()} >= {"entity:E3:artifact_path_escapes_root", "entity:E10:artifact_missing"}


def test_manifest_check(spark):
    kind = "path string, bytes long, sha256 string, is_link boolean"
    declared = spark.createDataFrame([("a", 1, "AA", False), ("b", 2, "bb", False), ("c", 3, "cc", False), ("d", 4, "dd", False)], kind)
    actual = spark.createDataFrame([("a", 1, "aa", False), ("b", 5, "xx", False), ("c", 3, "cc", True), ("e", 9, "ee", False)], kind)
    r = artifacts.manifest_check(declared, actual).first()
    assert (r.missing, r.unlisted, r.digest, r["size"], r.links, r.declared_files, r.actual_files, r.declared_bytes, r.actual_bytes) == (1, 1, 1, 1, 1, 4, 4, 10, 18)


def test_phonetic_lattices(spark):
    readings = [("行", "xing2"), ("行", "hang2"), ("航", "hang2"), ("形", "xing2"), ("型", "xing1"), ("好", "hao3"), ("号", "hao4"), ("号", "hao2")]
    pairs = [(1, "行", "航"), (2, "行", "形"), (3, "航", "形"), (4, "行", "型"), (5, "好行", "号航"), (6, "好", "好好"), (7, "好a", "好a"), (8, "好a", "号b"), (9, "", ""), (10, "？", "？")]
    got = {r.k: r.relation for r in transform.phonetic_relations(spark.createDataFrame(pairs, "k int, source string, replacement string"), spark.createDataFrame(readings, "character string, reading string"), "k").collect()}
    assert got == {1: "SAME_TONE", 2: "SAME_TONE", 3: "NEAR", 4: "TONE_VARIANT", 5: "TONE_VARIANT", 6: "NEAR", 7: "SAME_TONE", 8: "NEAR", 9: "SAME_TONE", 10: "SAME_TONE"}


def test_operation_labels(spark):
    rows = [(1, [("homophone", None, None), ("homophone", None, None), ("redundant_insertion", "WHITESPACE", None), ("redundant_insertion", "DOT", None), ("entry_surface", "DOT_DEFANG", None), ("emoji", None, True)]), (2, []), (3, None), (4, [("emoji", None, False), ("entry_surface", "other", None)])]
    df = spark.createDataFrame(rows, "k int, o array<struct<kind:string,detail:string,line_break:boolean>>")
    got = {r.k: list(r.x) for r in df.select("k", transform.operation_labels(F.col("o")).alias("x")).collect()}
    assert got == {1: ["entry_dot_defang", "homophone_or_similar_sound", "line_break_layout", "platform_emoji_insertion", "punctuation_interleaving", "whitespace_interleaving"], 2: [], 3: [], 4: ["platform_emoji_insertion"]}


def test_call_rollup(spark):
    calls = [
        ("r1", {"status": "PASS", "response_model": "m", "attempts": [{"response_model": "m-a", "usage": {"in": 3, "out": 2, "share": 0.5, "flag": True}}, {"usage": {"in": 4}}, "odd"]}),
        ("r1", {"status": "FAIL", "attempts": None}), ("r1", {}), ("r2", {"status": "PASS", "response_model": ""}),
    ]
    df = spark.createDataFrame([(r, json.dumps(c)) for r, c in calls], "r string, j string").select("r", F.parse_json("j").alias("c"))
    a, b = state.call_rollup(df, "r", "c").orderBy("r").collect()
    assert (a.successful_model_call_count, a.failed_model_call_count, a.model_call_audit_count, a.provider_attempt_count, a.resolved_models, a.token_usage) == (1, 2, 3, 2, ["m", "m-a"], {"in": 7, "out": 2})
    assert (b.successful_model_call_count, b.provider_attempt_count, b.resolved_models, b.token_usage) == (1, 0, [], {})


def test_canonical_text_as_python_writes_it(spark):
    rnd = random.Random(1)

    def value(depth):
        kind = rnd.random()
        if depth == 0 or kind < 0.5:
            return rnd.choice([None, True, 0, -7, 10**20, 1.0, 1e16, 1e-5, 0.1, 123456.789e-30, "é\n\"\\", "", "😀"])
        return [value(depth - 1) for _ in range(rnd.randint(0, 3))] if kind < 0.7 else {rnd.choice("zaéA_") * rnd.randint(1, 2): value(depth - 1) for _ in range(rnd.randint(0, 4))}

    values = [value(4) for _ in range(400)] + [{"drop": 1, "b": {"drop": 2}}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(-1, "{"), (-2, None)], "i int, j string")
    got = {r.i: r.c for r in df.select("i", canonical_text(F.col("j"), "drop").alias("c")).collect()}
    plain = lambda v: json.dumps({k: x for k, x in v.items() if k != "drop"} if isinstance(v, dict) else v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert all(got[i] == plain(v) for i, v in enumerate(values)) and got[-1] is None and got[-2] is None
