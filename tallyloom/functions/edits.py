"""Unit-cost edit distances of texts and of token lists, a batch of pairs at a time.

Most pairs are settled without a table of both lengths: where two sequences are equally long, the places at which they differ are an upper
bound, and what remains of these places' items after those that both sides hold is a lower one. Where the bounds meet that is the distance;
the other pairs are computed by bit vectors (Myers 1999, Hyyrö 2003), a whole column of the table at each step.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


#: Codes with more places than this have their bits made once.
OFTEN = 64


def _bits(places: list[int], size: int) -> int:
    bits = np.zeros(size, bool)
    bits[places] = True
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """The edit distance of two sequences of codes; memory grows with their lengths, not with the product."""
    n = min(len(a), len(b))
    start = next(iter(np.flatnonzero(a[:n] != b[:n])), n)
    a, b, n = a[start:], b[start:], n - start
    end = next(iter(np.flatnonzero(a[::-1][:n] != b[::-1][:n])), n)
    long, short = sorted((a[: len(a) - end].tolist(), b[: len(b) - end].tolist()), key=len, reverse=True)
    if not short:
        return len(long)
    places: dict[int, list[int]] = {code: [] for code in {*long} & {*short}}
    for i, code in enumerate(long):
        if code in places:
            places[code].append(i)
    often = {code: _bits(found, len(long)) for code, found in places.items() if len(found) > OFTEN}  # of codes that are there once or so a set of bits each would take the square of the length
    every = (1 << len(long)) - 1
    up, down = every, 0  # of a column: where the distance grows by one from its row to the next, and where it falls
    for code in short:
        same = often[code] if code in often else sum(1 << i for i in places.get(code, ()))
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        right, left = down | (every & ~(across | up)), up & across
        right, left = (right << 1 | 1) & every, (left << 1) & every
        up, down = left | (every & ~(vertical | right)), right & vertical
    return len(short) + up.bit_count() - down.bit_count()


def distances(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """The distance of each pair: the codes of all pairs one after another, and how many each has."""
    equal = a_sizes == b_sizes
    pair = np.repeat(np.arange(len(a_sizes))[equal], a_sizes[equal])
    x, y = a[np.repeat(equal, a_sizes)], b[np.repeat(equal, b_sizes)]
    differ = np.flatnonzero(x != y)
    pair, x, y = pair[differ], x[differ].astype(np.int64), y[differ].astype(np.int64)
    most = np.bincount(pair, minlength=len(a_sizes))
    keys, where = np.unique(np.concatenate([pair << 32 | x, pair << 32 | y]), return_inverse=True)
    surplus = np.bincount(where[: len(x)], minlength=len(keys)) - np.bincount(where[len(x) :], minlength=len(keys))
    least = np.bincount(keys >> 32, np.maximum(surplus, 0), minlength=len(a_sizes)).astype(np.int64)
    out, a_ends, b_ends = most, np.cumsum(a_sizes), np.cumsum(b_sizes)
    for i in np.flatnonzero(~equal | (least < most)):
        out[i] = distance(a[a_ends[i] - a_sizes[i] : a_ends[i]], b[b_ends[i] - b_sizes[i] : b_ends[i]])
    return out


def _of_pairs(a: pa.Array, b: pa.Array, coded) -> pa.Array:
    """Null where a side is null."""
    both = pc.and_(a.is_valid(), b.is_valid())
    (x, x_sizes), (y, y_sizes) = coded(a.filter(both), b.filter(both))
    out = np.zeros(len(both), np.int32)
    there = both.to_numpy(zero_copy_only=False)
    out[there] = distances(x, x_sizes, y, y_sizes)
    return pa.array(out, pa.int32(), mask=~there)


def _characters(*sides: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    texts = [side.to_pylist() for side in sides]
    return [(np.frombuffer("".join(t).encode("utf-32-le"), np.uint32), np.fromiter(map(len, t), np.int64, len(t))) for t in texts]


def _tokens(*sides: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    flat = [side.flatten() for side in sides]
    codes = pa.concat_arrays(flat).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    sizes = [side.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for side in sides]
    return [(codes[: len(flat[0])], sizes[0]), (codes[len(flat[0]) :], sizes[1])]


@F.arrow_udf(IntegerType())
def token_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """The edit distance of two lists of tokens."""
    return _of_pairs(a, b, _tokens)


def text_distances(token: str):
    """A function of two texts: what levenshtein gives of them, and the same of the lists of what the pattern matches in each."""
    pattern = re.compile(token)

    @F.arrow_udf(StructType([StructField(name, IntegerType()) for name in ("characters", "tokens")]))
    def both(a: pa.Array, b: pa.Array) -> pa.Array:
        def tokens(*sides: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
            return _tokens(*[pa.array(map(pattern.findall, side.to_pylist()), pa.list_(pa.string())) for side in sides])

        return pa.StructArray.from_arrays([_of_pairs(a, b, _characters), _of_pairs(a, b, tokens)], ["characters", "tokens"])

    return both
