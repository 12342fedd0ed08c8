"""Each stage against its brute-force version, on the stage's own input."""

import random

from tests.llm.test_op5 import brute as brute_classes

import corpus_pipeline


def small_corpus(spark, path):
    rnd = random.Random(8)
    vocabulary = [a + b for a in "ba ce di fo gu la me ni po ru sa te".split() for b in "n r s t l m".split()]
    docs, labels = [], []
    for i in range(420):
        words = rnd.choices(vocabulary, k=rnd.choice([6, 40, 120]))
        bad, rude = i % 7 == 0, i % 5 == 1
        if bad:
            words = [w + "%%%" for w in words]
        if rude:
            for _ in range(3):
                words[rnd.randrange(len(words))] = "zorg" + rnd.choice(["", "en", "ta"])
        text = " ".join(words)
        docs.append((i, text, rnd.choice(["en", "de"]), f"src{min(i % 9, 5)}", len(text)))
        labels.append((i, int(not bad), int(rude)))
        if i % 10 == 2:
            docs.append((1000 + i, text + " tail" if len(words) > 30 else text, "en", "src0", len(text)))
    docs += [(5000, "", "en", "src1", 0), (5001, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs, labels


def test_stages(spark, tmp_path):
    small_corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        after = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) < len(before)
        if name == "quality_classifier":
            assert {r.doc_id for r in after} == {r.doc_id for r in before if "%%%" not in (r.text or "")}
        elif name == "toxicity":
            assert {r.doc_id for r in after} == {r.doc_id for r in before if "zorg" not in (r.text or "")}
        elif name == "minhash_near_dedup":
            assert sorted(r.doc_id for r in after) == sorted(d for d, _, kept in brute_classes([(r.doc_id, r.text) for r in before]) if kept)
        elif name == "best_fit_packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert len({(r.sequence_id, r.offset) for r in after}) == len(after)


def test_run_is_the_stages(spark, tmp_path):
    small_corpus(spark, str(tmp_path))
    a = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    b = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert a == b and a
