"""Toxicity by a weighted finite-state grammar whose insult stems and slot weights are learned."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyloom.llm.common import Written, fresh, give_back
from tallyloom.llm.grammar import SLOTS, Grammar, pieces
from tallyloom.llm.labelled import fold, training_rows
from tallyloom.llm.shingles import STEP, mix
from tallyloom.llm.tokens import slices


#: Stems that a task counts before it hands its counts on.
FLUSH = 200_000


@dataclass(frozen=True)
class Settings:
    """max_rows: bound of the labelled sample, in documents. Two texts count as copies if they share `alike` of their three-word shingles."""

    max_rows: int = 20_000
    stem_lengths: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    min_support: int = 4
    precision: float = 0.95
    chance: float = 0.01
    coverage: float = 0.97
    minima: int = 64
    alike: float = 0.5


def _candidates(text: str, lengths: tuple[int, ...]) -> set[str]:
    words = {w for w in pieces(text.lower()) if len(w) >= 3}
    return words | {w[:k] for w in words for k in lengths if len(w) > k}


def _support(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """stem, toxic, clean: in how many training texts of each label a stem starts a word; counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for label, counts in enumerate(seen):
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([label] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["stem", "label", "n"])
                counts.clear()

        for batch in batches:
            for part, texts in slices(batch, "text"):
                for text, label in zip(texts.to_pylist(), part.column(1).to_pylist(), strict=True):
                    seen[label].update(_candidates(text, lengths))
                    if len(seen[0]) + len(seen[1]) > FLUSH:
                        yield from out()
        yield from out()

    n = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    return rows.select("text", "label").mapInArrow(run, "stem string, label int, n bigint").groupBy("stem").agg(n(1).alias("toxic"), n(0).alias("clean"))


def _is_significant(n_toxic: int, n_clean: int, s: Settings, tests: int) -> Column:
    """significant() over columns toxic and clean."""
    prior = n_toxic / max(n_toxic + n_clean, 1)
    n, share = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - prior))).otherwise(0.0) if prior < 1 else F.lit(0.0)
    kl = share * F.log(share / prior) + rest if prior < 1 else F.lit(0.0)
    return (share >= s.precision) & (n * kl > math.log(max(tests, 1) / s.chance))


def significant(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, s: Settings, tests: int) -> list[str]:
    """Stems that clean texts lack and whose support in toxic ones is no chance, by Bonferroni over so many tests."""
    prior = n_toxic / max(n_toxic + n_clean, 1)
    good = []
    for stem, k in toxic.items():
        n, share = k + clean.get(stem, 0), k / max(k + clean.get(stem, 0), 1)
        if not k or share < s.precision:
            continue
        # the chance that at least k of n texts are toxic is at most exp(-n KL(share, prior))
        kl = share * math.log(share / prior) + ((1 - share) * math.log((1 - share) / (1 - prior)) if share < 1 else 0.0) if prior < 1 else 0.0
        if n * kl > math.log(max(tests, 1) / s.chance):
            good.append(stem)
    return good


def choose_stems(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, s: Settings, tests: int | None = None) -> dict[str, float]:
    """Weights (log odds) of significant stems, best support first, each as long as its support allows."""
    if not toxic or not n_toxic:
        return {}
    good = significant(toxic, clean, n_toxic, n_clean, s, len(toxic) if tests is None else tests)
    rank = lambda x: (toxic[x] * (toxic[x] + 1) / (toxic[x] + clean.get(x, 0) + 1), -len(x), x)
    chosen: dict[str, float] = {}
    inside: set[str] = set()  # all beginnings of chosen stems
    in_order = sorted(good)
    for short in sorted(good, key=rank, reverse=True):
        if short in inside or any(short[:k] in chosen for k in range(1, len(short))):
            continue
        # the longest stem that covers nearly as much
        longer = takewhile(lambda x: x.startswith(short), islice(in_order, bisect_left(in_order, short), None))  # noqa: B023
        stem = max((x for x in longer if toxic[x] >= s.coverage * toxic[short]), key=lambda x: (len(x), x))
        inside.update(stem[:k] for k in range(1, len(stem) + 1))
        chosen[stem] = math.log(((toxic[stem] + 0.5) / (n_toxic + 1)) / ((clean.get(stem, 0) + 0.5) / (n_clean + 1)))
    return chosen


def signature(text: str, minima: int) -> bytes:
    """Minima (16 bits of each) of so many hashes of a text's three-word shingles."""
    words = text.lower().split()
    found = {zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(len(words) - 2, 1))}
    hashes = mix(np.array(sorted(found), np.uint64) + np.uint64(1))
    seeds = mix(np.arange(1, minima + 1, dtype=np.uint64) * STEP)
    least = np.full(minima, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1024):
        least = np.minimum(least, mix(hashes[start : start + 1024, None] ^ seeds).min(axis=0))
    return least.astype("<u2").tobytes()


def copy_classes(signatures: np.ndarray, alike: float) -> np.ndarray:
    """A class number for each signature: texts alike, and texts alike to those; pairs come from equal minima, two at a time."""
    root = np.arange(len(signatures))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for band in range(0, signatures.shape[1] - 1, 2):
        key = signatures[:, band].astype(np.uint32) << np.uint32(16) | signatures[:, band + 1]
        order = np.argsort(key, kind="stable")
        start = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        first = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
        later = np.flatnonzero(~start)
        for a, b in ((order[later], order[later - 1]), (order[later], order[first[later]])):
            same = (signatures[a] == signatures[b]).mean(axis=1) >= alike
            for x, y in zip(a[same].tolist(), b[same].tolist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(len(root))])


def _distinct_support(rows: DataFrame, stems: frozenset[str], s: Settings) -> dict[str, int]:
    """In how many different texts a stem's words stand: copies and near copies of a text are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                found = [(signature(x, s.minima), sorted(_candidates(x, s.stem_lengths) & stems)) for x in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.string()))], names=["sig", "stems"])

    held = Written(rows.select("text").mapInArrow(run, "sig binary, stems array<string>"), "copies")
    sigs = [bytes(r.sig) for r in held.df.where(F.size("stems") > 0).select("sig").distinct().orderBy("sig").collect()]  # max_rows at most
    if not sigs:
        held.drop()
        return {}
    classes = copy_classes(np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), -1), s.alike)
    known = rows.sparkSession.createDataFrame(list(zip(sigs, classes.tolist(), strict=True)), "sig binary, class long")
    each = held.df.join(known, "sig").select(F.explode("stems").alias("stem"), "class").distinct()
    got = {r.stem: r.n for r in each.groupBy("stem").agg(F.count("*").alias("n")).collect()}  # a row a significant stem
    held.drop()
    return got


def logistic(x: np.ndarray, y: np.ndarray, *, ridge: float = 1e-2, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with a ridge."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty * w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty), grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    stems: dict[str, float]
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.log1p(features) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def text_features(texts: pa.Array, grammar: Grammar) -> np.ndarray:
    """Slots of each whole text; the grammar runs over those that its gate lets through."""
    low = pc.utf8_lower(texts)
    out = np.zeros((len(texts), len(SLOTS)))
    for i in np.flatnonzero(pc.match_substring_regex(low, grammar.gate()).to_numpy(zero_copy_only=False)):
        out[i] = grammar.features(low[int(i)].as_py())
    return out


def fit(docs: DataFrame, labels: DataFrame, *, settings: Settings = Settings(), folds: int = 5, held_out: int = 0) -> Model:
    """Stems from the support counts of a bounded labelled sample, slot weights by logistic regression on it."""
    rows = Written(training_rows(docs, labels, "toxic", folds=folds, held_out=held_out, max_rows=settings.max_rows), "toxicity")
    sizes = {r.label: r.n for r in rows.df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    stems: dict[str, float] = {}
    if n_toxic:
        held = Written(_support(rows.df, settings.stem_lengths).where(F.col("toxic") >= settings.min_support), "stems")
        tests = held.df.count()
        good = held.df.where(_is_significant(n_toxic, n_clean, settings, tests)).collect()  # significant stems
        held.drop()
        if good:
            seen = _distinct_support(rows.df.where("label = 1"), frozenset(r.stem for r in good), settings)
            stems = choose_stems({r.stem: min(r.toxic, seen.get(r.stem, 0)) for r in good}, {r.stem: r.clean for r in good}, n_toxic, n_clean, settings, tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                x = text_features(texts, grammar)
                yield pa.RecordBatch.from_arrays([part.column(1), *[pa.array(c) for c in x.T]], names=["label", *SLOTS])

    kinds = "label int, " + ", ".join(f"{c} double" for c in SLOTS)
    got = sorted(tuple(r) for r in rows.df.mapInArrow(run, kinds).collect())  # max_rows at most
    rows.drop()
    if not got or n_toxic == 0 or n_clean == 0:
        return Model(stems, np.zeros(len(SLOTS)), math.log((n_toxic + 1) / (n_clean + 1)) if got else -5.0)
    data = np.array(got, float)
    weights, bias = logistic(np.log1p(data[:, 1:]), data[:, 0])
    return Model(stems, weights, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with _score (more underscores where the name is taken); null and empty texts get the bias alone."""
    name = fresh(docs.columns, "_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.stems)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                score = model.score(text_features(texts, grammar))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, name])
        give_back()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame, *, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels of the held-out fold are not read.

    Null, empty and unmatched texts get the score of no matched clause; texts of any length are read whole;
    repeated rows get a row each, of one score; a null id is not held out; without labels of both classes every
    score is the prior; empty tables give no rows; only doc_id and text are read.
    """
    got = scored(docs.select("doc_id", "text"), fit(docs, labels, settings=settings))
    return got.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
