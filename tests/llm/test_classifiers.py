import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.llm import grammar, labelled, quality, toxicity
from tallyloom.llm.grammar import Grammar


def corpus(n=900, seed=6):
    rnd = random.Random(seed)
    words = [a + b + c for a in "bcdfgl" for b in "aeiou" for c in ("", "n", "rt", "st")]
    docs, labels = [], []
    for i in range(n):
        w = rnd.choices(words, k=rnd.choice([3, 30, 120]))
        low, bad = i % 6 == 0, i % 9 == 1
        if low:
            w = rnd.choice([lambda: [x + "%%%" for x in w], lambda: [x.upper() + "!!" for x in w], lambda: [x for x in w for _ in range(9)]])()
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["zork", "zorkish", "blarg"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(not low), int(bad)))
    return docs + [(n, ""), (n + 1, None), (None, "zork zork"), docs[0]], labels + [(n + 9, 1, 1), (3, None, None), labels[0]]


def test_held_out_accuracy_and_folds(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit(3)).withColumn("_score", F.lit(9))
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for judged, at, folds, out in ((quality.judged, 0, 4, 2), (toxicity.judged, 1, 5, 0)):
        got = judged(d, l).collect()
        assert len(got) == len(docs)
        held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id < 900]
        assert all((zlib.crc32(str(r.doc_id).encode()) % folds == out) == r.held_out for r in got if r.doc_id is not None)
        assert np.mean([r.predicted == truth[r.doc_id][at] for r in held]) >= 0.97
        assert all(0 <= r.score <= 1 for r in got)
    # labels of the held-out fold change nothing
    flipped = l.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r.doc_id, r.score) for r in toxicity.judged(d, x).collect()} for x in (l, flipped))
    assert a == b


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    l = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for judged in (quality.judged, toxicity.judged):
        assert 0 <= judged(d, l).first().score <= 1
        assert judged(d.where("false"), l).count() == 0


def test_features_are_of_the_text_alone():
    texts = ["abc  de\n\tf", "", "x", "abc  de\n\tf", "é" * 700000, "abc de f"]
    model = quality.Model(np.random.default_rng(1).normal(size=quality.WIDTH), 0.1)
    whole = model.scores(pa.array(texts))
    alone = np.concatenate([model.scores(pa.array([t])) for t in texts])
    assert np.allclose(whole, alone) and whole[0] == whole[3]
    assert np.allclose(model.scores(pa.array(["skip", *texts]).slice(1)), whole)


def test_grammar_slots():
    g = Grammar({"zork": 2.0, "zor": 1.0})
    slots = lambda t: dict(zip(("plain", "negated", "reported", "aimed", "threat", "threat_off"), g.features(t)))
    assert slots("a zorkish day.")["plain"] == 2.0 and slots("the amzork")["plain"] == 0
    assert slots("you zork.")["aimed"] == 2.0 and slots("you went. zork")["aimed"] == 0
    assert slots("this is not a zork")["negated"] == 2.0 and slots("not. a zork")["plain"] == 2.0
    assert slots("he said zork")["reported"] == 2.0 and slots('he said "it is. zork" zork')["reported"] == 2.0
    assert slots("l'zork d’zorka")["plain"] == 4.0 and slots("c'est pas un zork")["negated"] == 2.0 and slots("it isn’t a zork")["negated"] == 2.0
    assert slots("i will kill you")["threat"] == 1.0 and slots("he said i will kill you")["threat_off"] == 1.0 and slots("kill time")["threat"] == 0


def test_stems_need_support():
    s = toxicity.Settings()
    toxic = {"zor": 41, "zork": 40, "zorki": 20, "rare": 2, "common": 60}
    got = toxicity.choose_stems(toxic, {"common": 500}, 100, 900, s)
    assert set(got) == {"zork"}


def test_insults_after_the_same_word_are_learned_and_copies_are_not(spark):
    rnd = random.Random(8)
    words = [a + b + c for a in "bcdfgl" for b in "aeiou" for c in ("", "n", "rt", "st")]
    copied = [*rnd.choices(words, k=30), "oddword", *rnd.choices(words, k=30)]
    docs = []
    for i in range(900):
        w = rnd.choices(words, k=20)
        if i % 9 == 1:
            w[10:12] = ["you", "zork"]
        elif i % 3 == 0:
            w[10] = "you"
        if i % 18 == 2:  # toxic near copies
            w = list(copied)
            w[rnd.randrange(20)] = rnd.choice(words)
        docs.append((i, " ".join(w), int(i % 9 == 1 or i % 18 == 2)))
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    stems = toxicity.fit(d, d.select("doc_id", "toxic")).stems
    assert set(stems) == {"zork"}


def test_rare_insults_among_many_common_words_are_learned(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(8000)]
    docs = [(i, " ".join(rnd.sample(words, 1000 if i % 6 == 0 else 300)), int(i % 6 == 0)) for i in range(1800)]
    docs = [(i, t + " zork" if y and i % 90 == 0 else t, y) for i, t, y in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    assert set(toxicity.fit(d, d.select("doc_id", "toxic")).stems) == {"zork"}


def plain_slots(text, stems):
    """The grammar by looking back from each insult and threat over the words of the text."""
    words = list(grammar.pieces(text.lower()))
    insult = lambda w: max((v for k, v in ((k, v) for k, v in stems.items() if w.startswith(k))), key=lambda v: max(len(k) for k in stems if w.startswith(k) and stems[k] == v), default=None)
    out = dict.fromkeys(grammar.SLOTS, 0.0)
    kinds = []
    for w in words:
        kinds.append("," if w == "," else "." if w in ".!?;\n" else '"' if w in '"“”„«»' else "i" if w.isalpha() and insult(w) is not None else next((k for k, ws in (("u", grammar.TARGETS), ("t", grammar.THREATS), ("n", grammar.NEGATIONS), ("r", grammar.REPORTS), ("f", grammar.FUTURES)) if w in ws), "o"))

    def negated(i):
        left = grammar.NEGATION_REACH
        for k in reversed(kinds[:i]):
            if k == "n":
                return left > 0
            if k == ".":
                return False
            left -= k not in ',"'
        return False

    def reported(i):
        state = 0
        for k in kinds[:i]:
            state = max(state, 1) if k == "r" else {0: 0, 1: 2, 2: 0}[state] if k == '"' else 0 if k == "." and state == 1 else state
        return state > 0

    for i, k in enumerate(kinds):
        start = max((j + 1 for j in range(i) if kinds[j] == "."), default=0)
        if k == "i":
            weight = insult(words[i])
            out["negated" if negated(i) else "reported" if reported(i) else "plain"] += weight
            out["aimed"] += weight * ("u" in kinds[start:i])
        if k == "u":
            trail = "".join(x for x in kinds[start:i] if x in "ftu")
            while "u" in trail:  # a target before a verb means nothing, one after it ends the threat
                j = trail.index("u")
                head = trail[:j]
                trail = ("f" if valid(head) else "".join(head)) + trail[j + 1 :]
            if valid(trail):
                out["threat_off" if negated(i + 1) or reported(i + 1) else "threat"] += 1
    return [out[s] for s in grammar.SLOTS]


def valid(trail):
    """A future, then at least one threat verb, the last word of them a verb."""
    tail = trail[trail.rfind("f") :] if "f" in trail else ""
    return len(tail) > 1


def test_grammar_against_looking_back():
    rnd = random.Random(4)
    vocabulary = ["zork", "zorkish", "blarg", "you", "not", "said", "will", "kill", "beat", "day", "tree", "isn't", "l'zork", ",", ".", '"', "nie", "tu"]
    stems = {"zork": 2.0, "zorki": 3.0, "blarg": 1.0}
    g = Grammar(stems)
    for _ in range(1500):
        text = " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 16)))
        assert g.features(text).tolist() == plain_slots(text, stems), text


def test_scores_follow_from_plain_counts(spark):
    docs, labels = corpus(400)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_SCORE", F.lit(9))
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    s = toxicity.Settings()
    model = toxicity.fit(d, l)
    known = {i: t for i, _, t in labels if i is not None and i < 400 and t is not None and zlib.crc32(str(i).encode()) % 5}
    toxic, clean = Counter(), Counter()
    for i, text in {i: t or "" for i, t in docs if i in known}.items():
        (toxic if known[i] else clean).update(toxicity._candidates(text, s.stem_lengths))
    toxic = {k: n for k, n in toxic.items() if n >= s.min_support}
    n1 = sum(known.values())
    assert model.stems == toxicity.choose_stems(toxic, clean, n1, len(known) - n1, s)
    for r in toxicity.judged(d, l).collect():
        text = next(t for i, t in docs if i == r.doc_id) or ""
        x = np.log1p(plain_slots(text, model.stems)) @ model.weights + model.bias
        assert abs(r.score - 1 / (1 + np.exp(-x))) < 1e-9 and r.predicted == int(r.score >= 0.5)


def plain_features(text):
    """Hashed words, n-grams and repeats, one by one in Python's integers."""
    wide, base, odd = (1 << 64) - 1, int(quality.BASE), int(quality.ODD)
    padded = [32 if 9 <= ord(c) <= 13 else ord(c) for c in f" {text} "]
    out = Counter()
    for kind, n in enumerate(quality.GRAMS):
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if 32 not in gram[1:-1]:
                h = 0
                for c in gram:
                    h = (h * base + c) & wide
                out[((h * odd & wide) >> (64 - quality.BITS)) + (kind << quality.BITS)] += 1
    at, last, last_end = 0, None, None
    while at < len(padded):
        if padded[at] == 32:
            at += 1
            continue
        end = at
        while padded[end] != 32:
            end += 1
        h = sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(padded[at:end])) & wide
        out[quality.WIDTH - 1 if h == last and at - last_end == 1 else quality.WIDTH - 2] += 1
        out[(((h ^ (h >> 31)) * odd & wide) >> (64 - quality.BITS)) + (len(quality.GRAMS) << quality.BITS)] += 1
        last, last_end, at = h, end, end
    return out


def test_quality_against_plain_descent(spark):
    texts = ["ab cd cd", "éx éx ü", "", "a", "日本 語 語", "x\ty  y", "zz zz zz q"] * 3
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    l = spark.createDataFrame([(i, int(i % 7 in (0, 2, 3))) for i in range(len(texts))], "doc_id long, quality int")
    s = quality.Settings(epochs=3)
    model = quality.fit(d, l, settings=s)
    rows = [(int(i % 7 in (0, 2, 3)), plain_features(t)) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 4 != 2]
    arrays = [(y, np.array(sorted(f), "<i4"), np.array([f[k] for k in sorted(f)], "<u4")) for y, f in rows]
    arrays.sort(key=lambda x: (x[0], len(x[1]), zlib.crc32(x[1]), zlib.crc32(x[2])))
    rng = np.random.default_rng(s.seed)
    v = rng.uniform(-1 / s.dim, 1 / s.dim, (quality.WIDTH, s.dim)).astype(np.float32).astype(float)
    out, bias, step = np.zeros((2, s.dim)), np.zeros(2), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(arrays)):
            y, f, c = arrays[i]
            w = c / (c.sum() + quality.PAD)
            rate = s.rate * (1 - step / (s.epochs * len(arrays)))
            mean = sum((w[k] * v[f[k]] for k in range(len(f))), np.zeros(s.dim))
            p = np.exp(out @ mean + bias)
            p /= p.sum()
            p[y] -= 1
            for k in range(len(f)):
                v[f[k]] -= 0.2 * rate * w[k] / (w @ w) * (p @ out)
            out -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            step += 1
    got = model.scores(pa.array(texts))
    for t, score in zip(texts, got, strict=True):
        f = plain_features(t)
        z = sum(n * (v[k] @ (out[1] - out[0])) for k, n in f.items()) / (sum(f.values()) + quality.PAD) + bias[1] - bias[0]
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-4


def test_repeated_ids_and_contradicting_labels_when_fitting(spark):
    d = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, "c"), (3, "d"), (4, None)], "doc_id long, text string")
    l = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (4, 0), (None, 1)], "doc_id long, toxic int")
    got = labelled.training_rows(d, l, "toxic", folds=5, held_out=-7, max_rows=10)
    assert sorted(map(tuple, got.collect())) == [("", 0), ("a", 1)]
    assert labelled.training_rows(d, l, "toxic", folds=5, held_out=-7, max_rows=1).count() == 1
