"""Language identification by error-correcting output codes.

As in Dietterich and Bakiri, "Solving Multiclass Learning Problems via Error-Correcting Output Codes" (1995), and the
loss-based decoding of Allwein, Schapire and Singer, "Reducing Multiclass to Binary" (2000): every language has a
codeword of +1 and -1, a binary classifier over character n-grams predicts each of its bits, and the codeword of least
weighted loss wins. A classifier's feature weights are log odds between the n-grams of the languages with +1 and of those
with -1, each language counting alike; they come from counts of all training documents, made by Spark. Its threshold lies
between the two sets of languages, its weight in the decoding is the gap there, so that a bit which hardly separates
its languages hardly counts.

Texts are lower-cased; everything but letters and marks separates words; n-grams of 1 to 3 characters are taken within a
word with one separator on each side.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from tallyloom.llm.common import fresh, give_back, per_process
from tallyloom.llm.labelled import fold

GRAMS = (1, 2, 3)
BITS = 14
WIDTH = len(GRAMS) << BITS
ODD, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
#: Characters in a slice; longer texts are read in several.
SLICE = 100_000
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """max_langs: more language values than this are an error, for the model holds a vector of counts for each.

    smooth: what is added to each count; evidence: n-grams from which on a text counts as fully heard;
    sharp: how steeply losses become shares; random_bits, tries: bits per doubling of the languages, and random codes looked at.
    """

    max_langs: int = 256
    smooth: float = 0.5
    evidence: int = 60
    sharp: float = 4.0
    random_bits: int = 10
    tries: int = 200
    seed: int = 12


def codewords(k: int, s: Settings = Settings()) -> np.ndarray:
    """A row of +1 and -1 for each of k classes.

    Up to 5 classes all the ways to part them (distance 2^(k-2) between any two); beyond that the random code of greatest
    least distance among some, whose columns are all different, part the classes, and aren't each other's opposites.
    """
    def of(columns) -> np.ndarray:
        """The ways to part the classes by number; the first class is always on the side of +1."""
        return np.array([[1 if i == 0 or not int(c) >> (i - 1) & 1 else -1 for c in columns] for i in range(k)], np.int8).reshape(k, len(columns))

    ways = (1 << max(k - 1, 0)) - 1
    if k <= 5:
        return of(range(1, ways + 1))
    n, rng, best, far = max(15, ceil(s.random_bits * log2(k))), np.random.default_rng(s.seed), None, -1
    for _ in range(s.tries):
        code = of(rng.choice(ways, n, replace=False) + 1) if k <= 16 else rng.choice(np.array([-1, 1], np.int8), (k, n))
        if k > 16:
            code *= code[0]
            if len({c.tobytes() for c in code.T}) < n or (code == 1).all(axis=0).any():
                continue
        least = int(distances(code).min())
        if least > far:
            best, far = code, least
    if far < 1:
        raise ValueError(f"no code of {n} bits tells {k} classes apart")
    return best


def distances(code: np.ndarray) -> np.ndarray:
    """Differing bits of every two codewords."""
    wide = code.astype(np.int32)
    far = (code.shape[1] - wide @ wide.T) // 2
    return far[~np.eye(len(code), dtype=bool)]


def _classes() -> np.ndarray:
    """For each code point 1 if it is a letter, 2 if it is a mark, else 0."""
    kinds = {"L": 1, "M": 2}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(code points, first place of each text with the end, first text, places to start an n-gram from).

    Each text stands between separators of its own; what is no letter or mark is a separator. A text longer than SLICE comes in several slices of itself.
    """
    kinds = per_process("letter classes", _classes)

    def coded(text: str) -> np.ndarray:
        out = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        out[kinds[out] == 0] = 32
        return out

    held, size = [], 0
    for i, text in enumerate(texts):
        low = text.lower()
        if held and size + len(low) > SLICE:
            yield _joined(held, i - len(held), coded)
            held, size = [], 0
        if len(low) > SLICE:
            data = coded(f" {low} ")
            for at in range(0, len(data), SLICE):
                part = data[at : at + SLICE + max(GRAMS) - 1]
                yield part, np.array([0, len(part)]), i, min(SLICE, len(data) - at)
        else:
            held.append(low)
            size += len(low)
    if held:
        yield _joined(held, len(texts) - len(held), coded)


def _joined(held: list[str], first: int, coded) -> tuple[np.ndarray, np.ndarray, int, int]:
    data = coded(" " + "  ".join(held) + " ")
    return data, np.concatenate([[0], np.cumsum([len(t) + 2 for t in held])]), first, len(data)


def grams(data: np.ndarray, starts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, bucket) of the n-grams that begin before `starts`; each n has buckets of its own."""
    space, wide = data == 32, data.astype(np.uint64)
    for kind, n in enumerate(GRAMS):
        m = min(starts, len(data) - n + 1)
        if m <= 0:
            continue
        h, no = np.zeros(m, np.uint64), space[:m] & space[n - 1 : m + n - 1] if n < 3 else np.zeros(m, bool)
        for i in range(n):
            h = h * BASE + wide[i : i + m]
            if 0 < i < n - 1:
                no |= space[i : i + m]
        at = np.flatnonzero(~no)
        yield at, ((h[at] * ODD) >> np.uint64(64 - BITS)).astype(np.int64) + (kind << BITS)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text) if len(text) < 200 else bool((per_process("letter classes", _classes)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")] == 1).any())


def language_counts(rows: DataFrame, settings: Settings = Settings()) -> dict[str, np.ndarray]:
    """n-gram counts of each language over all rows (lang, text): vectors of each task, added up by one task a language.

    The driver gets one vector of WIDTH counts for each language; more than max_langs of them raise ValueError.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = total.setdefault(lang, np.zeros(WIDTH, np.int64))
                if len(total) > settings.max_langs:
                    raise ValueError(f"more than {settings.max_langs} languages")
                for data, _, _, starts in slices([t for t, x in zip(texts, langs) if x == lang]):
                    for _, f in grams(data, starts):
                        own += np.bincount(f, minlength=WIDTH)
        yield from vectors(total)
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[lang] = total.get(lang, 0) + np.frombuffer(counts.as_py(), np.int64)
        yield from vectors(total)

    def vectors(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([counts.tobytes()], pa.binary())], names=["lang", "counts"])

    kind = "lang string, counts binary"
    parts = rows.select("lang", "text").mapInArrow(count, kind).repartition("lang").mapInArrow(add, kind)
    found = {r.lang: np.frombuffer(r.counts, np.int64) for r in parts.limit(settings.max_langs + 1).toLocalIterator()}
    if len(found) > settings.max_langs:
        raise ValueError(f"more than {settings.max_langs} languages")
    return {lang: found[lang] for lang in sorted(found) if found[lang].any()}


@dataclass
class Model:
    """langs and their codewords; odds: a weight for each n-gram bucket and bit; cut, gap: the middle and half the distance between the two sides of a bit."""

    langs: list[str]
    code: np.ndarray
    odds: np.ndarray
    cut: np.ndarray
    gap: np.ndarray
    settings: Settings

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(mean weight of each text's n-grams in each bit, number of n-grams)."""
        total, count = np.zeros((len(texts), self.odds.shape[1])), np.zeros(len(texts))
        for data, begin, first, starts in slices(texts):
            for at, f in grams(data, starts):
                edge = np.searchsorted(at, begin)
                sums = np.concatenate([np.zeros((1, self.odds.shape[1])), np.cumsum(self.odds[f], axis=0, dtype=np.float64)])
                total[first : first + len(begin) - 1] += sums[edge[1:]] - sums[edge[:-1]]
                count[first : first + len(begin) - 1] += np.diff(edge)
        return total / np.maximum(count, 1)[:, None], count

    def decoded(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, its share, bits that differ from its codeword, whether it is in doubt) of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int32), np.ones(len(texts), bool)
        s, code = self.settings, self.code.astype(np.float64)
        mean, count = self.margins(texts)
        heard = np.minimum(1.0, count / s.evidence)[:, None]
        z = np.clip((mean - self.cut) / np.maximum(np.abs(self.gap), 1e-6), -3, 3)
        weight = np.maximum(self.gap, 1e-3)
        # loss of bit b for language l: ln(1 + e^(-2 code z)); the weights sum to 1
        loss = np.stack([(np.logaddexp(0, -2 * z * c) * (weight / weight.sum())).sum(axis=1) if len(c) else np.zeros(len(texts)) for c in code], axis=1)
        share = np.exp(-s.sharp * heard * len(self.langs) ** 0.5 * (loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        wrong = ((z[:, None, :] >= 0) != (code[None] > 0)).sum(axis=2)
        own = wrong[np.arange(len(texts)), best]
        least = int(distances(self.code).min()) if len(self.langs) > 1 else 0
        doubt = (own > max(0, (least - 1) // 2)) | ((wrong == own[:, None]).sum(axis=1) > 1) | (share.max(axis=1) < 0.5)
        known = np.array([has_letter(t) for t in texts], bool)
        langs = [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
        return langs, np.where(known, share.max(axis=1), 0.0), np.where(known, own, 0).astype(np.int32), doubt | ~known


def learned(counts: dict[str, np.ndarray], settings: Settings = Settings()) -> Model:
    """The classifier of every bit, from the counts alone."""
    langs = sorted(counts)
    code = codewords(len(langs), settings)
    share = np.array([(counts[x] + settings.smooth) / (counts[x].sum() + settings.smooth * WIDTH) for x in langs]).reshape(len(langs), WIDTH)
    plus = code.T == 1
    odds = np.array([np.log(share[p].mean(axis=0)) - np.log(share[~p].mean(axis=0)) for p in plus]).reshape(len(plus), WIDTH).T
    expected = share @ odds  # the mean weight in each bit of a long text of each language
    low = np.array([expected[p, b].min() for b, p in enumerate(plus)])
    high = np.array([expected[~p, b].max() for b, p in enumerate(plus)])
    return Model(langs, code, odds.astype(np.float32), (low + high) / 2, (low - high) / 2, settings)


def fit(docs: DataFrame, *, settings: Settings = Settings(), folds: int = 4, held_out: int = 2) -> Model:
    """Learns from text and non-null lang of all documents outside the held-out fold; nothing else of a document is read."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    return learned(language_counts(rows, settings), settings)


def identified(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns of docs with lang_pred, score, bit_errors, ambiguous (with underscores before names that are taken)."""
    names = [fresh(docs.columns, c) for c in ("lang_pred", "score", "bit_errors", "ambiguous")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH weights for each bit, whatever the corpus
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, wrong, doubt = shared.value.decoded([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(wrong), pa.array(doubt)], names=[*batch.schema.names, *names])
        give_back()

    kinds = (StringType(), DoubleType(), IntegerType(), BooleanType())
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds))]))


def predicted(docs: DataFrame, *, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bit_errors, ambiguous for every row of docs.

    Null texts and texts without a letter are `und` with score 0. Texts of any length are read whole, in slices;
    repeated rows get a row each; a null id is not held out, so its row is learned from. Equal losses go to the
    first language in order. With no language to learn from every row is `und`; with one, every text with a letter is
    of that language with score 1. Empty tables give no rows; only doc_id, text and lang are read.
    """
    got = identified(docs.select("doc_id", "text"), fit(docs, settings=settings))
    return got.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "bit_errors", "ambiguous")
