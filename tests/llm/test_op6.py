import random

from tokenizers import Tokenizer

from tallyloom.llm.token_counts import length_histogram, length_quantile, length_report, truncated_total
from tallyloom.llm.tokens import tokenizer_path


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta!", "x1", "ÉÉ"], k=rnd.choice([0, 1, 3, 300, 700]))), rnd.choice(["en", "de", None])) for i in range(120)] + [(5, None, "en"), (6, "", None), (6, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    plain = Tokenizer.from_file(tokenizer_path())
    size = {}
    for _, t, lang in rows:
        size.setdefault(lang, []).append(len(plain.encode(t or "", add_special_tokens=False).ids))
    hist = length_histogram(df, by=("lang",))
    got = {(r.lang, r.length): r for r in length_report(hist, by=("lang",), block=16).collect()}
    assert len(got) == sum(len(set(v)) for v in size.values())
    for (lang, limit), r in got.items():
        own = size[lang]
        assert r.n_docs == own.count(limit) and r.docs_over == sum(x > limit for x in own) and r.tokens_total == sum(own)
        assert r.truncated_total == sum(min(x, limit) for x in own) and r.docs_upto == sum(x <= limit for x in own)
    every = sorted(x for v in size.values() for x in v)
    whole = length_histogram(df)
    for limit in (0, 1, 13, 900, 10**6):
        assert truncated_total(whole, limit).first()[0] == sum(min(x, limit) for x in every)
    for q in (0.1, 0.5, 0.95, 1.0):
        assert length_quantile(length_report(whole), q).first()[0] == next(x for i, x in enumerate(every) if (i + 1) / len(every) >= q and (i + 1 == len(every) or every[i + 1] > x))
    assert length_report(length_histogram(df.where("false"))).count() == 0


def test_clashing_names_and_a_very_long_text(spark):
    rows = [(1, "x", "alpha beta", "a"), (1, None, "alpha", "b"), (2, "x", "alpha " * 200_000, "a"), (2, "x", None, "a")]
    df = spark.createDataFrame(rows, "length int, _text string, body string, n_docs string")
    plain = Tokenizer.from_file(tokenizer_path())
    n = [len(plain.encode(r[2] or "", add_special_tokens=False).ids) for r in rows]
    for by in (("length",), ("_text",), ("n_docs", "length"), ("_text", "n_docs", "length")):
        hist = length_histogram(df, text="body", by=by)
        assert hist.columns[: len(by)] == list(by) and len(set(hist.columns)) == len(by) + 2
        at = [df.columns.index(c) for c in by]
        want = {}
        for r, size in zip(rows, n):
            key = (*[r[i] for i in at], size)
            want[key] = want.get(key, 0) + 1
        assert {tuple(r)[:-1]: r[-1] for r in hist.collect()} == want
        report = length_report(hist, by=by)
        assert len(set(report.columns)) == len(by) + 8 and report.count() == len(want)
