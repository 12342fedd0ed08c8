import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tallyloom.llm import language_id as L
from tallyloom.llm.language_id import Settings, codewords, distances, fit, identified, predicted

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "oux", "ç"], "dd": ["ción", "ñ", "lla"], "ee": ["ж", "зд", "ий"]}


def sentence(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 4))) for _ in range(n))


def corpus(n=400, langs=("aa", "bb", "cc", "dd")):
    rnd = random.Random(2)
    return [(i, sentence(rnd, langs[i % len(langs)], rnd.choice([3, 10, 60])), langs[i % len(langs)]) for i in range(n)]


def plain_grams(text):
    """Every n-gram as a string, one place at a time."""
    low = "".join(c if KINDS[c] else " " for c in f" {text.lower()} ")
    return [low[i : i + n] for n in L.GRAMS for i in range(len(low) - n + 1) if low[i : i + n].strip() and " " not in low[i + 1 : i + n - 1]]


class _Kinds(dict):
    def __missing__(self, c):
        import unicodedata

        self[c] = unicodedata.category(c)[0] in "LM"
        return self[c]


KINDS = _Kinds()


def bucket(gram):
    h = 0
    for c in gram:
        h = (h * int(L.BASE) + ord(c)) % 2**64
    return (((h * int(L.ODD)) % 2**64) >> (64 - L.BITS)) + ((len(gram) - 1) << L.BITS)


def plain_counts(rows):
    out = {}
    for _, text, lang in rows:
        out.setdefault(lang, Counter()).update(map(bucket, plain_grams(text)))
    return out


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6, 9, 40])
def test_codewords(k):
    code = codewords(k)
    assert code.shape[0] == k and set(np.unique(code)) <= {-1, 1}
    assert all((c == 1).any() and (c == -1).any() for c in code.T)
    assert len({c.tobytes() for c in code.T} | {(-c).tobytes() for c in code.T}) == 2 * code.shape[1]
    least = min(int((a != b).sum()) for a, b in combinations(code, 2))
    assert least == int(distances(code).min()) >= (2 ** (k - 2) if k <= 5 else code.shape[1] // 4)
    assert (codewords(k) == code).all()


def test_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "SLICE", 64)  # most texts come in several slices
    rows = corpus(60) + [(90, "İstanbul ÀÉ\n\tx2y हिन्दी", "aa"), (91, "a", "bb"), (92, "", "bb"), (93, "zz " * 500, "cc")]
    got = L.language_counts(spark.createDataFrame(rows, SCHEMA).repartition(4))
    want = plain_counts(rows)
    assert set(got) == set(want)
    for lang, counts in got.items():
        assert {int(b): int(counts[b]) for b in np.flatnonzero(counts)} == want[lang]


def test_decoding_against_brute_force(spark):
    rows = corpus(200)
    model = fit(spark.createDataFrame(rows, SCHEMA))
    langs, s = model.langs, Settings()
    train = plain_counts([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2])
    share = {x: [(train[x][b] + s.smooth) / (sum(train[x].values()) + s.smooth * L.WIDTH) for b in range(L.WIDTH)] for x in langs}
    code = {x: model.code[i] for i, x in enumerate(langs)}
    bits = range(model.code.shape[1])
    mean = lambda side, bit, b: sum(share[x][b] for x in langs if code[x][bit] == side) / sum(code[x][bit] == side for x in langs)
    odds = [[math.log(mean(1, i, b) / mean(-1, i, b)) for b in range(L.WIDTH)] for i in bits]
    expected = {x: [sum(p * o for p, o in zip(share[x], odds[i])) for i in bits] for x in langs}
    cut, gap = [], []
    for i in bits:
        low, high = min(expected[x][i] for x in langs if code[x][i] == 1), max(expected[x][i] for x in langs if code[x][i] == -1)
        cut.append((low + high) / 2)
        gap.append((low - high) / 2)
    texts = [r[1] for r in rows[:30]] + ["ka", "sch eau", "x"]
    got, score, wrong, _ = model.decoded(texts)
    for text, lang, sc, w in zip(texts, got, score, wrong):
        found = [bucket(g) for g in plain_grams(text)]
        z = [min(3, max(-3, (sum(odds[i][b] for b in found) / len(found) - cut[i]) / gap[i])) for i in bits]
        loss = {x: sum(math.log1p(math.exp(-2 * z[i] * code[x][i])) * gap[i] for i in bits) / sum(gap) for x in langs}
        best = min(langs, key=lambda x: (loss[x], x))
        heard = min(1, len(found) / s.evidence)
        assert lang == best and w == sum((z[i] >= 0) != (code[best][i] > 0) for i in bits)
        assert sc == pytest.approx(1 / sum(math.exp(-s.sharp * heard * len(langs) ** 0.5 * (loss[x] - loss[best])) for x in langs), abs=1e-3)


@pytest.mark.parametrize("langs", [("aa", "bb"), ("aa", "bb", "cc", "dd"), tuple(SYLLABLES)])
def test_held_out_accuracy(spark, langs):
    rows = corpus(500, langs)
    got = {r.doc_id: r for r in predicted(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(got) == 500 and all(got[r[0]].held_out == (r in held) for r in rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_are_not_read(spark):
    rows = corpus(120)
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows]
    one, two = (predicted(spark.createDataFrame(r, SCHEMA)).orderBy("doc_id").collect() for r in (rows, wrong))
    assert one == two


def test_cases(spark):
    rows = corpus(80) + [(500, None, "aa"), (501, "", "aa"), (502, "12 !? 34", "bb"), (503, "kato mi", None), (None, "kato mika", "aa"), (504, "kato " * 100_000, "aa"), (504, "kato", "aa"), (504, "kato", "aa")]
    got = predicted(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 and by[i][0].ambiguous for i in (500, 501, 502))
    assert by[503][0].lang_pred == "aa" and by[None][0].held_out is False and [r.lang_pred for r in by[504]] == ["aa"] * 3
    mixed = identified(spark.createDataFrame([(1, sentence(random.Random(1), "aa", 30) + " " + sentence(random.Random(1), "bb", 20))], "score int, text string"), fit(spark.createDataFrame(rows, SCHEMA)))
    assert mixed.columns == ["score", "text", "lang_pred", "_score", "bit_errors", "ambiguous"] and mixed.first().lang_pred in ("aa", "bb")


def test_few_languages_and_empty_tables(spark):
    assert predicted(spark.createDataFrame([], SCHEMA)).collect() == []
    none = predicted(spark.createDataFrame([(1, "abc", None)], SCHEMA)).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    one = predicted(spark.createDataFrame([(i, "abc", "aa") for i in range(8)] + [(9, "?", "aa")], SCHEMA)).orderBy("doc_id").collect()
    assert {(r.lang_pred, r.score) for r in one[:-1]} == {("aa", 1.0)} and one[-1].lang_pred == "und"
    with pytest.raises(Exception, match="more than 2 languages"):
        fit(spark.createDataFrame(corpus(40), SCHEMA), settings=Settings(max_langs=2))
