import random

import pytest

from tallyloom.functions.rng import Stream
from tallyloom.operators.dictionary import dictionary_matches, dictionary_rewrites
from tallyloom.operators.transform import PLACEHOLDER, Edit, apply_edits, invert_edits, lexicon_edits


def plain(text, rules):
    """Every place looked at with every rule."""
    order = sorted((r for r in rules if r["source"]), key=lambda r: (-len(r["source"]), r["rule_id"]))
    at, out = 0, []
    while at < len(text):
        if text.startswith(PLACEHOLDER, at):
            at += len(PLACEHOLDER)
            continue
        ahead = text.find(PLACEHOLDER, at)
        room = (len(text) if ahead < 0 else ahead) - at
        rule = next((r for r in order if len(r["source"]) <= room and text.startswith(r["source"], at)), None)
        if rule:
            out.append((at, at + len(rule["source"]), rule["source"], rule["rule_id"]))
        at += len(rule["source"]) if rule else 1
    return out


def some(rnd, n, letters="abé中"):
    return ["".join(rnd.choices(letters, k=rnd.randint(0, 5))) for _ in range(n)]


def entries_of(spark, rules):
    return spark.createDataFrame([(r["rule_id"], r["source"], r["candidates"], r["probability"]) for r in rules], "rule_id string, source string, candidates array<string>, probability double").repartition(3)


def lexicon(rnd, n):
    return [{"rule_id": f"r{rnd.randint(0, 99):02d}{i}", "source": s, "candidates": [s, s.upper() + "*", "z"], "probability": rnd.choice([0.3, 1.0])} for i, s in enumerate(some(rnd, n) + ["a", "a"])]


@pytest.mark.parametrize("most_bytes", [1 << 20, 300])
def test_against_every_place_and_rule(spark, most_bytes):
    rnd = random.Random(3)
    rules = lexicon(rnd, 40)
    texts = [(i, "".join(rnd.choices(["a", "b", "é", "中", "x", PLACEHOLDER, "{{"], k=rnd.randint(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "ab" * 20_000), (7, "ab")]
    rows = spark.createDataFrame(texts, "id long, t string").repartition(3)
    got = sorted(map(tuple, dictionary_matches(rows, entries_of(spark, rules), "id", "t", most_bytes=most_bytes).collect()))
    assert got == sorted((i, *m) for i, t in texts for m in plain(t or "", rules))
    best = {r["source"]: r for r in sorted(rules, key=lambda r: r["rule_id"], reverse=True)}
    want = {}
    for i, t in texts:
        new, placed = apply_edits(t or "", lexicon_edits(t or "", [r for r in best.values() if r["source"]], Stream(f"s|{i}")))
        want.setdefault(i, set()).add((None if t is None else new, tuple((e.start, e.end, e.before, e.after, e.rule_id, e.out_start) for e in placed)))
    back = dictionary_rewrites(rows, entries_of(spark, rules), "id", "t", seed="s", most_bytes=most_bytes).collect()
    assert len(back) == len(texts)
    for r in back:
        edits = tuple(map(tuple, r.edits))
        assert (r.t, edits) in want[r.id]
        assert r.t is None or invert_edits(r.t, [Edit(e.start, e.end, e.source, e.replacement, e.rule_id, e.out_start) for e in r.edits]) in [t for i, t in texts if i == r.id]


def test_a_hundred_thousand_entries(spark):
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choices("abcdefghij", k=rnd.randint(3, 9))) for _ in range(150_000)})[:100_000]
    entries = spark.createDataFrame([(f"r{i}", w) for i, w in enumerate(words)], "rule_id string, source string")
    text = "".join(rnd.choices("abcdefghij", k=20_000))
    known, longest, at, want = {w: f"r{i}" for i, w in enumerate(words)}, max(map(len, words)), 0, []
    while at < len(text):
        hit = next((text[at : at + n] for n in range(longest, 2, -1) if text[at : at + n] in known and at + n <= len(text)), None)
        want += [(1, at, at + len(hit), hit, known[hit])] if hit else []
        at += len(hit) if hit else 1
    got = sorted(map(tuple, dictionary_matches(spark.createDataFrame([(1, text)], "id long, t string"), entries, "id", "t").collect()))
    assert len(words) == 100_000 and got == want


def test_empty_sides(spark):
    rows, none = spark.createDataFrame([(1, "abc")], "id long, t string"), spark.createDataFrame([], "rule_id string, source string")
    assert dictionary_matches(rows, none, "id", "t").collect() == []
    assert dictionary_matches(rows.where("false"), spark.createDataFrame([("r", "a")], "rule_id string, source string"), "id", "t").collect() == []
