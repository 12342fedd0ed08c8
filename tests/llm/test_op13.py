import hashlib
import math
import random
import re
import zlib

import pytest

from tallyloom.llm import resampling
from tallyloom.llm.resampling import Draw, resampled

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def plain_features(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return found, [zlib.crc32(f.encode()) for f in found + [f"{a} {b}" for a, b in zip(found, found[1:])]]


def plain(docs, targets, draw):
    s, t = [0] * draw.buckets, [0] * draw.buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, targets)):
        for text in texts:
            for f in plain_features(text)[1]:
                counts[f % draw.buckets] += 1
    ratio = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s) + draw.buckets) / ((s[b] + 1) * (sum(t) + draw.buckets))))
    gain, rows = [ratio(b) for b in range(draw.buckets)], []
    for doc_id, text in docs:
        found, features = plain_features(text)
        weight = math.floor(sum(gain[f % draw.buckets] for f in features) / len(features)) if features else 0
        h = int(hashlib.sha256(f"{draw.seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(found)])
    may = sorted((r for r in rows if r[4] >= draw.min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    rank = {id(r): i + 1 for i, r in enumerate(may[: draw.percent * len(may) // 100])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def corpus(n=300):
    rnd = random.Random(5)
    some = ["Alpha", "beta", "ÉTÉ", "été", "x1", "中文", "gamma-delta", "İ", "naïve", "_", "--", "\x85", "a b"]
    return [(i, rnd.choice([" ", "\n", ", "]).join(rnd.choices(some, k=rnd.choice([0, 1, 5, 25, 60])))) for i in range(n)]


@pytest.mark.parametrize("draw", [Draw(), Draw(buckets=7, percent=60, min_words=1), Draw(buckets=50, percent=0)])
def test_against_brute_force(spark, draw):
    docs = corpus() + [(300, None), (301, ""), (None, "alpha beta " * 20), (None, "alpha beta " * 20), (7, "alpha beta " * 30), (7, "alpha beta " * 30), (303, "wort " * 40_000)]
    targets = ["alpha beta gamma", "Alpha x1 " * 30, None, ""]
    got = resampled(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame([(t,) for t in targets], "text string"), draw)
    assert rows_of(got) == plain(docs, targets, draw)


def test_ties_go_by_id_across_blocks_of_scores(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 4)
    docs = [(i % 40, "one two three " * 8) for i in range(400)]  # ten rows of each id
    got = rows_of(resampled(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame([("one",)], "text string")))
    assert got == plain(docs, ["one"], Draw())
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 101))


def test_documents_near_the_target_are_preferred(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choices(["north", "east"] if i % 2 else ["red", "blue"], k=40))) for i in range(400)]
    got = resampled(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(" ".join(rnd.choices(["north", "east"], k=50)),) for _ in range(20)], "text string"))
    drawn = [r.doc_id for r in got.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and sum(d % 2 for d in drawn) > 75


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], SCHEMA)
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampled(none, target).collect() == []
    docs = [(i, "word " * 25) for i in range(8)]
    assert rows_of(resampled(spark.createDataFrame(docs, SCHEMA), target.where("false"))) == plain(docs, [], Draw())
    clash = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in docs], "score long, body string, _id int, weight int, rank int, buckets int, above int")
    got = resampled(clash.withColumnRenamed("score", "key"), target, doc_id="key", text="body")
    assert sorted(r.key for r in got.where("rank IS NOT NULL").collect()) == sorted(r[0] for r in plain(docs, ["a b"], Draw()) if r[4])
