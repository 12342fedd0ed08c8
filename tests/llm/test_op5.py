import random
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.llm.alignment import alike
from tallyloom.llm.near_duplicates import Settings, bucketing, near_duplicates, one_of_each
from tallyloom.llm.shingles import shingled


def plain_alike(a, b):
    """The whole dynamic programme."""
    if not a or not b:
        return len(a) == len(b)
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            here = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(row[j + 1], row[j])
            last = here
    return row[-1] * 9 >= 4 * (len(a) + len(b))


def test_banded_alignment_is_exact():
    rnd = random.Random(2)
    for _ in range(600):
        n = rnd.choice([0, 1, 3, 20, 60])
        a = [rnd.randrange(rnd.choice([3, 40, 1000])) for _ in range(n)]
        b = list(a)
        for _ in range(rnd.randrange(1 + n // 3)):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randrange(2)] = [rnd.randrange(50)] * rnd.randrange(2)
        if rnd.random() < 0.2:
            b = b[n // 10 :] + b[: n // 10]
        assert alike(np.array(a, "<u4"), np.array(b, "<u4")) == plain_alike(a, b)


def test_repeated_shingles_align_quickly():
    rnd = random.Random(3)
    a = np.full(20_000, 7, "<u4")
    b = a.copy()
    for x in (a, b):
        x[[rnd.randrange(20_000) for _ in range(2)]] = rnd.randrange(1 << 30)
    start = time.perf_counter()
    assert alike(a, b)
    assert time.perf_counter() - start < 2


def shingles(text, k=5):
    w = (text or "").lower().split()
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [])


def edited_pairs(lengths, want, seed):
    """Pairs of texts of so many shingles whose similarity is 0.8 or little more: words replaced until one more would be too many."""
    rnd = random.Random(seed)
    a, b = [], []
    while len(a) < want:
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice(lengths) + 4)]
        other, kept = list(words), None
        for _ in range(1 + len(words) // 20):
            k, how = rnd.randrange(len(other)), rnd.randrange(3)
            other[k : k + (how > 0)] = [] if how == 1 else [f"w{rnd.randrange(5000)}"]
            if not alike(*(np.array([zlib.crc32(repr(g).encode()) for g in shingles(" ".join(w))], "<u4") for w in (words, other))):
                break
            kept = list(other)
        if kept is not None and kept != words:
            a.append(" ".join(words))
            b.append(" ".join(kept))
    return a, b


def share(pairs, settings):
    of = bucketing(settings)
    found = [[set(of(x).tolist()) for x in shingled(pa.array(side), 5)] for side in pairs]
    return sum(bool(x & y) for x, y in zip(*found, strict=True)) / len(pairs[0])


def test_all_short_pairs_are_candidates():
    pairs = edited_pairs(range(4, 25), 3000, 5)
    assert share(pairs, Settings()) == 1
    assert share(pairs, Settings(short=0)) < 1, "the sketches alone miss some"


def test_recall_of_long_pairs():
    assert share(edited_pairs(range(25, 60), 1500, 6), Settings()) >= 0.99
    assert share(edited_pairs([300], 300, 7), Settings()) >= 0.99


def brute(rows):
    seqs = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = seqs[i], seqs[j]
            if find(i) != find(j) and min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and plain_alike(a, b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if r not in least else min(least[r], d)
    return sorted((d, least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed=4):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    passage = rnd.choices(words, k=60)
    rows = []
    for g in range(25):
        base = rnd.choices(words, k=rnd.choice([4, 9, 80, 250]))
        if g % 3 == 0:
            base = passage + base
        for _ in range(rnd.choice([1, 2, 9])):
            t = list(base)
            for _ in range(int(len(t) * rnd.choice([0, 0, 0.01, 0.02, 0.03]))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append(" ".join(t))
    hot = rnd.choices(words, k=120)
    for _ in range(60):  # many copies around the threshold
        t = list(hot)
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append(" ".join(t))
    rows += ["", None, " \n", "One two", "one  TWO", "a b a b a b a b a b a b a b", "a b a b a b a b a b a b a b a b", "x " * 5000]
    return [(i, t) for i, t in enumerate(rows)]


def test_classes_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("n", F.lit(1))
    for s in (Settings(), Settings(block=8), Settings(block=3)):
        assert sorted(tuple(r) for r in near_duplicates(df, s).drop("key").collect()) == brute(rows)
    kept = one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, k in brute(rows) if k)


def test_pairs_that_meet_only_by_their_rarest_shingles(spark):
    """A large bucket is dealt anew; two of its texts may have their rare shingles to themselves."""
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{i}_{rnd.randrange(9000)}" for _ in range(60)])) for i in range(12)]
    rows[9] = (9, rows[5][1] + " end")
    for seed in range(50):
        s = Settings(sketches=1, minima=1, short=0, block=4, seed=seed)
        if len({int(bucketing(s)(x)[0]) for x in shingled(pa.array([t for _, t in rows]), 5)}) == 1:
            break
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df, s).collect()} == {i: 5 if i == 9 else i for i in range(12)}


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (3, "q")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df).drop("key").collect()), key=str) == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (3, 3, True)], key=str)
    assert sorted((r.doc_id or 0, r.text) for r in one_of_each(df.unionAll(df)).collect()) == [(0, "z"), (1, "a b c d e f"), (3, "q")]
    assert near_duplicates(df.where("false")).count() == 0
