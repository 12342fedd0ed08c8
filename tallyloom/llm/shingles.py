"""Hashes of words and word shingles over slices of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of so many bytes, or one text, if that is longer.
SLICE_BYTES = 500_000
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def byte_slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, first byte of each text with the end): every text between two spaces of its own, white space as spaces."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1)
        sizes = np.diff(offsets[start : stop + 1]) + 2
        begin = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full(begin[-1], 32, np.uint8)
        body = flat[offsets[start] : offsets[stop]]
        out[np.arange(len(body)) + 2 * np.repeat(np.arange(stop - start), sizes - 2) + 1] = body
        out[(out >= 9) & (out <= 13)] = 32
        yield out, begin
        start = stop


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of the words of a slice, between spaces."""
    edge = np.diff((data == 32).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    base = 0x100000001B3
    power, back = np.full(len(data), base, np.uint64), np.full(len(data), pow(base, -1, 1 << 64), np.uint64)
    power[:1] = back[:1] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * power)])
    return begin, mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))


@dataclass
class Shingled:
    """One text: its word shingles in order, their occurrence-labelled hashes, and 128 bits of its words."""

    shingles: np.ndarray
    labelled: np.ndarray
    key: bytes


def shingled(texts: pa.Array, k: int) -> Iterator[Shingled]:
    """Lower-cased words between white space; a text of fewer than k words is one shingle, one without words has none."""
    for data, begin in byte_slices(pc.utf8_lower(texts)):
        at, h = word_hashes(data)
        doc = np.searchsorted(begin, at, side="right") - 1
        first = np.searchsorted(at, begin)
        place = (np.arange(len(h)) - first[doc]).astype(np.uint64)
        keys = []
        for salt in (MIX1, MIX2):
            part = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h * salt + (place + np.uint64(1)) * STEP))])
            keys.append(mix(part[first[1:]] - part[first[:-1]] + np.diff(first).astype(np.uint64)))
        grams = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for i in range(k):
            grams = mix(grams * MIX2 + h[i : i + len(grams)] + np.uint64(i + 1))
        for d in range(len(begin) - 1):
            lo, hi = first[d], first[d + 1]
            if hi - lo >= k:
                s = grams[lo : hi - k + 1]
                order = np.argsort(s, kind="stable")
                run = s[order]
                start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                times = np.empty(len(s), np.uint64)
                times[order] = (np.arange(len(s)) - np.repeat(start, np.diff(np.concatenate([start, [len(s)]])))).astype(np.uint64)
                labelled = mix(s + times * STEP)
            else:
                s = labelled = keys[0][d : d + 1] if hi > lo else np.zeros(0, np.uint64)
            yield Shingled(s, labelled, keys[0][d].tobytes() + keys[1][d].tobytes())
