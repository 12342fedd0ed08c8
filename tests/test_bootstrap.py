"""Blocked products against a loop that draws rows."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.rng import twister_draws
from tallyloom.operators import reproduction, statistics
from tallyloom.operators.scoring import BOTTOM

TYPES, REPLICATES = ("A", "B", "C"), 60
SCHEMA = "model string, ordinal long, gold_decision string, gold_type string, web_pred_decision string, web_pred_type string, gate_pass boolean, gated_pred_decision string, gated_pred_type string"


def rows_of(models=("m1", "m2"), n=70, seed=5):
    rnd, out = random.Random(seed), []
    gold = [(rnd.choice(statistics.DECISIONS), rnd.choice(TYPES)) for _ in range(n)]
    for m in models:
        for i, (gd, gt) in enumerate(gold):
            wd, wt, gate = (gd if rnd.random() < 0.6 else rnd.choice(statistics.DECISIONS)), rnd.choice([*TYPES, None]), rnd.random() < 0.7
            out.append((m, 10 * i - 50, gd, gt, wd, wt, gate, wd if gate else BOTTOM, wt if gate else BOTTOM))
    return out


def f1(pairs, labels):
    total = 0.0
    for x in labels:
        tp, p, g = sum(a == b == x for a, b in pairs), sum(b == x for _, b in pairs), sum(a == x for a, _ in pairs)
        precision, recall = tp / p if p else 0.0, tp / g if g else 0.0
        total += 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return total / len(labels)


def plain(rows):
    out, n = {"entry_gate_pass": sum(r[6] for r in rows) / len(rows)}, len(rows)
    for prefix, d, t in (("web", 4, 5), ("gated", 7, 8)):
        out[f"{prefix}_decision_accuracy"] = sum(r[2] == r[d] for r in rows) / n
        out[f"{prefix}_decision_macro_f1"] = f1([(r[2], r[d]) for r in rows], statistics.DECISIONS)
        out[f"{prefix}_violation_type_macro_f1"] = f1([(r[3], r[t] if r[d] == "VIOLATION" else BOTTOM) for r in rows if r[2] == "VIOLATION"], TYPES)
        out[f"{prefix}_hierarchical_exact_match"] = sum(r[2] == r[d] and r[3] == r[t] for r in rows) / n
    return out | {"gate_loss": out["web_decision_accuracy"] - out["gated_decision_accuracy"]}


def plain_bootstrap(rows, seeds):
    out = {}
    for model, seed in seeds.items():
        own, rnd, drawn = sorted(r for r in rows if r[0] == model), random.Random(seed), []
        for _ in range(REPLICATES):
            drawn.append(plain([own[rnd.randrange(len(own))] for _ in own]))
        for metric, point in plain(own).items():
            values = sorted(x[metric] for x in drawn)
            out[model, metric] = (point, values[round((REPLICATES - 1) * 0.025)], values[round((REPLICATES - 1) * 0.975)])
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_paired_bootstrap_against_a_loop(spark, block):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    seeds = statistics.model_seeds(df, 20260727)
    got = statistics.paired_bootstrap(df, twister_draws(spark, seeds=seeds, replicates=REPLICATES, size=70), TYPES, block=block).collect()
    want = plain_bootstrap(rows, seeds)
    assert {(r.model, r.metric) for r in got} == set(want)
    for r in got:
        assert (r.point, r.ci_low, r.ci_high) == pytest.approx(want[r.model, r.metric], abs=1e-12)


def test_stream_draws(spark):
    got = statistics.stream_draws(spark.createDataFrame([("a", 7), ("b", 3), ("c", 0)], "stream string, size long"), 5, salt="s").collect()
    assert {(r.stream, r.replicate): 0 for r in got}.keys() == {(s, i) for s in "ab" for i in range(5)}
    assert all(sum(r.times for r in got if (r.stream, r.replicate) == (s, i)) == n for s, n in (("a", 7), ("b", 3)) for i in range(5))


def scored_of(rows):
    return [(m, f"Shown {m}", f"case{o}", gd, gt, wd, wt, True) for m, o, gd, gt, wd, wt, *_ in rows]


SCORED = "model string, display_model string, case_ref string, gold_decision string, gold_type string, pred_decision string, pred_type string, strict_report_eligible boolean"


def test_web_only_recomputation(spark):
    rows = rows_of(("m1", "m2", "m3"))
    seeds = {"m1": 7, "m2": 8}
    want = plain_bootstrap([r for r in rows if r[0] in seeds], seeds)
    figures = [(f"Shown {m}", k, *v) for (m, k), v in want.items() if k.startswith("web_")]
    figures[0] = (*figures[0][:2], figures[0][2] + 1e-9, *figures[0][3:])
    figures = spark.createDataFrame(figures, "model string, metric string, point double, ci_low double, ci_high double")
    mapping = spark.createDataFrame(sorted({(f"case{r[1]}", r[1]) for r in rows}), "case_ref string, ordinal long")
    draws = twister_draws(spark, seeds=seeds, replicates=REPLICATES, size=70)
    scored = scored_of(rows)
    run = lambda s, m=mapping: reproduction.web_only(spark.createDataFrame(s, SCORED).repartition(3), m, figures, draws, TYPES)
    got = run(scored).collect()
    assert {r.model for r in got} == {"m1", "m2"} and len(got) == 8
    assert sum(r.point_match for r in got) == 7 and all(r.low_match and r.high_match for r in got)
    status = reproduction.reproduction_status(run(scored)).first()
    assert (status.status, status.point_matches, status.ci_endpoint_matches, status.ci_endpoint_comparisons) == ("PARTIAL_MATCH_SEE_COMPARISON", 7, 16, 16)
    other = [(*s[:3], "NON_VIOLATION", *s[4:]) if s[0] == "m1" and s[3] == "VIOLATION" else s for s in scored]
    for broken, message in ((scored[1:], "cases of the mapping"), (scored + scored[:1], "cases of the mapping"), (other, "differ in gold"), ([(*s[:7], False) for s in scored], "not eligible")):
        with pytest.raises(Exception, match=message):
            run(broken).collect()
    with pytest.raises(Exception, match="one to one"):
        run(scored, mapping.withColumn("ordinal", F.lit(1))).collect()


def test_patterns_say_what_rows_say(spark, monkeypatch):
    rows = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    monkeypatch.setattr(statistics, "PLACES", 32)
    monkeypatch.setattr(statistics, "DRAWN", 19)
    sizes = rows.groupBy(F.col("model").alias("stream")).agg(F.count("*").alias("size"))
    draws = statistics.stream_draws(sizes, 20, salt="s")
    a, b = statistics.paired_bootstrap(rows, draws, TYPES), statistics.bootstrap_by_patterns(rows, TYPES, replicates=20, salt="s")
    assert a.columns == b.columns and a.orderBy("model", "metric").collect() == b.orderBy("model", "metric").collect()
