"""Quality classifier: supervised subword embeddings.

As in Joulin et al., "Bag of Tricks for Efficient Text Classification" (2016): a document
is the mean of learned vectors of its hashed words and character n-grams (with a word's
borders), followed by a softmax; numpy stochastic gradient descent. One pair of vectors is
added to the method: whether a word repeats the one before it, which hashed words can't show.
The mean counts PAD features of no effect besides a document's own, so that a few words
alone don't carry a verdict.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyloom.llm.common import Written, fresh, give_back
from tallyloom.llm.labelled import fold, training_rows

GRAMS = (3, 4)
BITS = 15
PAD = 30
#: Features in all; the last two say whether a word repeats the one before it.
WIDTH = ((len(GRAMS) + 1) << BITS) + 2
ODD, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
#: Texts are handled in slices of so many bytes, or one text, if that is longer.
SLICE_BYTES = 500_000


@dataclass(frozen=True)
class Settings:
    """max_rows: bound of the labelled sample that the model is fitted on, in documents."""

    max_rows: int = 8000
    dim: int = 8
    epochs: int = 6
    rate: float = 0.5
    seed: int = 7
    accept: float = 0.7


def char_slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, first place of each text with the end): every text between two spaces of its own, white space as spaces."""
    texts = texts.cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, side="right")))
        begin = np.concatenate([[0], np.cumsum(chars[start:stop] + 2)])
        joined = " " + "  ".join(texts.slice(start, stop - start).to_pylist()) + " "
        out = np.frombuffer(joined.encode("utf-32-le"), "<u4").copy()
        out[(out >= 9) & (out <= 13)] = 32
        yield out, begin
        start = stop


def features(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, hashed feature) of n-grams of characters and of words; features of different kinds have ranges of their own."""
    space = data == 32
    wide = data.astype(np.uint64)
    out = []
    for kind, n in enumerate(GRAMS):
        m = len(data) - n + 1
        if m <= 0:
            continue
        h, inner = np.zeros(m, np.uint64), np.zeros(m, bool)
        for i in range(n):
            h = h * BASE + wide[i : i + m]
            if 0 < i < n - 1:
                inner |= space[i : i + m]
        at = np.flatnonzero(~inner)
        out.append((at, ((h[at] * ODD) >> np.uint64(64 - BITS)).astype(np.int64) + (kind << BITS)))
    edge = np.diff(space.astype(np.int8))
    begin, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    if len(begin):
        power, back = np.full(len(data), BASE, np.uint64), np.full(len(data), pow(int(BASE), -1, 1 << 64), np.uint64)
        power[0] = back[0] = 1
        power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * power)])
        h = (sums[end] - sums[begin]) * back[begin]
        same = np.concatenate([[False], h[1:] == h[:-1]])
        same &= np.concatenate([[False], begin[1:] - end[:-1] == 1])  # two spaces stand between documents
        out.append((begin, np.where(same, WIDTH - 1, WIDTH - 2)))
        out.append((begin, (((h ^ (h >> np.uint64(31))) * ODD) >> np.uint64(64 - BITS)).astype(np.int64) + (len(GRAMS) << BITS)))
    return out


@dataclass
class Model:
    """gain: what a feature adds to the logit of class 1 over class 0, before the mean; bias: the logit of no feature."""

    gain: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for data, begin in char_slices(texts):
            total, count = np.zeros(len(begin) - 1), np.zeros(len(begin) - 1)
            for at, f in features(data):
                doc = np.searchsorted(begin, at, side="right") - 1
                total += np.bincount(doc, weights=self.gain[f], minlength=len(total))
                count += np.bincount(doc, minlength=len(total))
            out.append(1 / (1 + np.exp(-np.clip(total / (count + PAD) + self.bias, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)


def bags(train: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, features, counts) of the bounded training rows, fetched one partition at a time; counts take 2 bytes, or 4 in a text that needs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, row = batch.column(1).to_pylist(), 0
            for data, begin in char_slices(batch.column(0)):
                found = features(data)
                kept = []
                for i in range(len(begin) - 1):
                    parts = [f[np.searchsorted(at, begin[i]) : np.searchsorted(at, begin[i + 1])] for at, f in found]
                    kept.append(np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels[row : row + len(kept)], pa.int32()), pa.array([f.astype("<i4").tobytes() for f, _ in kept], pa.binary()), pa.array([c.astype("<u2" if c.max(initial=0) < 1 << 16 else "<u4").tobytes() for _, c in kept], pa.binary())],
                    names=["label", "f", "c"],
                )
                row += len(kept)

    rows = [(r.label, np.frombuffer(r.f, "<i4"), np.frombuffer(r.c, "<u4" if len(r.c) == len(r.f) else "<u2")) for r in train.select("text", "label").mapInArrow(run, "label int, f binary, c binary").toLocalIterator()]
    return sorted(rows, key=lambda x: (x[0], len(x[1]), zlib.crc32(x[1]), zlib.crc32(x[2])))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> Model:
    """Stochastic gradient descent over documents with a falling rate. Without two classes the model gives the prior."""
    n1 = sum(y for y, _, _ in rows)
    if not 0 < n1 < len(rows):
        return Model(np.zeros(WIDTH), float(np.log((n1 + 1) / (len(rows) - n1 + 1))))
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (WIDTH, s.dim)).astype(np.float32)
    out, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    steps, step = s.epochs * len(rows), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            y, f, c = rows[i]
            w, rate = (c / (c.sum() + PAD)).astype(np.float32), s.rate * (1 - step / steps)
            mean = w @ vectors[f] if len(f) else np.zeros(s.dim, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            err = p / p.sum()
            err[y] -= 1
            if len(f):  # a document's mean moves by the rate, however many features share it
                vectors[f] -= rate * (w / (w @ w))[:, None] * (err @ out)[None, :] * 0.2
            out -= rate * np.outer(err, mean)
            bias -= np.float32(0.1 * rate) * err
            step += 1
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, *, settings: Settings = Settings(), folds: int = 4, held_out: int = 2) -> Model:
    rows = Written(training_rows(docs, labels, "quality", folds=folds, held_out=held_out, max_rows=settings.max_rows), "quality")
    model = train(bags(rows.df), settings)
    rows.drop()
    give_back()
    return model


def scored(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """All columns of docs with _score (more underscores where the name is taken); null and empty texts get the bias alone."""
    name = fresh(docs.columns, "_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH doubles, whatever the corpus
    at = [i for i, c in enumerate(docs.columns) if c == text][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(pc.fill_null(batch.column(at), ""))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])
        give_back()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame, *, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels of the held-out fold are not read.

    Null and empty texts get the score of no features; texts of any length are read whole; repeated rows get
    a row each, of one score; a null id is not held out; without labels of both classes every score is the prior;
    empty tables give no rows; only doc_id and text are read, so that other columns may have any name.
    """
    got = scored(docs.select("doc_id", "text"), fit(docs, labels, settings=settings))
    return got.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= settings.accept).cast("int").alias("predicted"))
