import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.mixing import KEYS, Mixture, cell_table, marginals, mixed, raked_cells, uniform

TOPIC = lambda t: "licence" if re.search(r"(?i)\blicensed? under\b|\bcopyright\b", t) else "table" if "|" in t else "numeric" if re.search("[0-9]", t) else "prose"


def documents(n=1500, seed=2):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(rnd.choice(["word", "more", "7", "a|b", "text"][: rnd.choice([1, 2, 3, 5, 5])]) for _ in range(rnd.randrange(1, 60)))
        out.append((i, text, rnd.choice(["en", "en", "de"]), rnd.choice(["hot"] * 6 + ["a", "b", "c"]), 0))
    return [*out, (n, None, None, None, None), (n + 1, "", "en", "a", 0), (None, "copyright x", "de", "b", 1), out[0]]


def plain(rows, mix):
    """Raking, scaling and drawing in plain Python."""
    cells = {}
    for _, t, lang, src, _ in rows:
        key = (src or "", lang or "", TOPIC(t or ""))
        cells[key] = cells.get(key, 0) + len((t or "").split())
    held = {k: float(v) for k, v in cells.items() if v}
    total = sum(held.values())
    tokens = dict(held)
    share = []
    for axis in range(3):
        sums = {}
        for k, v in tokens.items():
            sums[k[axis]] = sums.get(k[axis], 0) + v
        given = mix.given.get(KEYS[axis], {})
        rest = sum(v**mix.power for c, v in sums.items() if c not in given)
        left = max(1 - sum(given[c] for c in sums if c in given), 0)
        share.append({c: given.get(c, v**mix.power / rest * left if rest else 0) for c, v in sums.items()})
    for _ in range(mix.sweeps):
        for axis in range(3):
            sums = {}
            for k, v in held.items():
                sums[k[axis]] = sums.get(k[axis], 0) + v
            held = {k: v * share[axis][k[axis]] * total / sums[k[axis]] for k, v in held.items()}
    weight = {k: held[k] / tokens[k] for k in held}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(t * min(1, c * weight[k]) for k, t in tokens.items()) < mix.budget * total else (lo, c)
    return {k: min(1.0, hi * weight[k]) for k in weight}


@pytest.mark.parametrize("mix", [Mixture(), Mixture(power=0.5, budget=0.3), Mixture(given={"source": {"a": 0.5}, "lang": {"de": 0.6, "en": 0.4}}, budget=0.2)])
def test_against_plain_python(spark, mix):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_mix", F.lit("x")).withColumn("topic", F.lit("y"))
    want = plain(rows, mix)
    got = {tuple(r[k] for k in KEYS): r.probability for r in raked_cells(cell_table(df), mix).where("tokens > 0").collect()}
    assert got == pytest.approx(want, rel=1e-6)
    out = mixed(df, mix)
    assert out.columns == [*df.columns, "__mix"]
    u = lambda i: int(hashlib.sha256(f"{mix.seed}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
    drawn = sorted(str(r[0]) for r in rows if u(r[0]) < want.get((r[3] or "", r[2] or "", TOPIC(r[1] or "")), 1.0))
    assert sorted(str(r.doc_id) for r in out.collect()) == drawn


def test_marginals_are_met(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    mix = Mixture(given={"lang": {"de": 0.6, "en": 0.4}}, budget=0.1)
    cells = raked_cells(cell_table(df), mix).withColumn("drawn", F.col("tokens") * F.col("probability"))
    share = {r.lang: r.s for r in cells.groupBy("lang").agg((F.sum("drawn")).alias("s")).collect()}
    assert share["de"] / sum(share.values()) == pytest.approx(0.6, abs=1e-6)


def test_empty_and_shuffled(spark):
    df = spark.createDataFrame(documents(200), "doc_id long, text string, lang string, source string, n_chars long")
    assert mixed(df.where("false")).count() == 0
    assert raked_cells(cell_table(df.where("false")), Mixture()).count() == 0
    few, many = (sorted(str(r.doc_id) for r in mixed(df, Mixture(max_broadcast_cells=n)).collect()) for n in (50_000, 0))
    assert few == many
    assert all(0 <= r[0] < 1 for r in df.select(uniform(F.col("doc_id"), 1)).collect())


def test_targets_that_cannot_be_met_are_reported(spark):
    rows = [(i, "word " * 10, "en" if i % 2 else "de", "a" if i % 2 else "b", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mix = Mixture(given={"lang": {"de": 0.9, "en": 0.1}, "source": {"a": 0.9, "b": 0.1}}, sweeps=5, budget=0.1)
    with pytest.warns(UserWarning, match="not settled"):
        got = {(r.axis, r.category): r for r in marginals(df, mix).collect()}
    assert got["lang", "de"].target == 0.9 and got["source", "a"].target == 0.9
    assert abs(got["lang", "de"].raked + got["source", "a"].raked - 1) < 1e-9
    zero = Mixture(given={"lang": {"de": 0.0, "en": 1.0}}, budget=0.2, sweeps=2)
    assert {r.lang for r in mixed(df, zero).collect()} <= {"en"}


def test_own_topics_long_texts_and_report(spark):
    rows = [(i, "word " * (20000 if i == 7 else 5), "en", "s", "t1" if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, theme string")
    mix = Mixture(given={"topic": {"t1": 0.25}}, budget=0.05)
    got = {(r.axis, r.category): r for r in marginals(df, mix, topic="theme").collect()}
    assert got["topic", "t1"].raked == pytest.approx(0.25) and got["topic", ""].raked == pytest.approx(0.75)
    assert sum(r.expected for (axis, _), r in got.items() if axis == "topic") == pytest.approx(1)
    assert {r["_mix"]["topic"] for r in mixed(df, Mixture(budget=1.0), topic="theme").collect()} == {"t1", ""}
