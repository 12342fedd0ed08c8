"""Banded alignment of two sequences of hashes by bit-parallel longest common subsequence."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

#: Two sequences are alike if aligned matches m fulfil m / (n1 + n2 - m) >= NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5


def needed(total: int) -> int:
    """The least m with m / (total - m) >= 4/5."""
    return -(-NUMERATOR * total // (NUMERATOR + DENOMINATOR))


def lengths_allow(n1: int, n2: int) -> bool:
    return min(n1, n2) * DENOMINATOR >= NUMERATOR * max(n1, n2)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the best alignment within the band has the needed matches.

    More than total - 2 * needed unmatched members already fail, so no alignment that passes
    leaves a band of that many diagonals on either side.
    """
    n1, n2 = len(a), len(b)
    if n1 == 0 or n2 == 0:
        return n1 == n2
    if not lengths_allow(n1, n2):
        return False
    need, short = needed(n1 + n2), min(n1, n2)
    off = np.flatnonzero(a[:short] != b[:short])
    head = int(off[0]) if len(off) else short
    if head >= need:
        return True
    a, b, short = a[head:], b[head:], short - head
    off = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(off[0]) if len(off) else short
    if tail:
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    left, band = need - head - tail, n1 + n2 - 2 * need
    if left <= 0:
        return True
    if min(len(a), len(b)) < left:
        return False
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    both, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < left:
        return False
    return banded_lcs(a, b, band, both) >= left


def banded_lcs(a: np.ndarray, b: np.ndarray, band: int, both: np.ndarray) -> int:
    """Longest common subsequence with matches at most `band` diagonals off; one machine-word step covers many columns.

    A symbol with many places in b has its bit mask made once, and the band cut out of it; the places of the others are
    looked up within the band.
    """
    n, many = len(b), max(64, len(b) >> 10)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], both), np.searchsorted(b[order], both, side="right")
    places = {x: order[i:j].tolist() for x, i, j in zip(both.tolist(), low.tolist(), high.tolist(), strict=True)}
    masks: dict[int, int] = {}
    full = (1 << n) - 1
    v = full
    for i, x in enumerate(a.tolist()):
        at = places.get(x)
        first, last = max(i - band, 0), min(i + band, n - 1)
        if at is None or first > last:
            continue
        if len(at) > many:
            if x not in masks:
                masks[x] = int.from_bytes(np.packbits(b == x, bitorder="little").tobytes(), "little")
            mask = (masks[x] >> first & (1 << last - first + 1) - 1) << first
        else:
            mask = 0
            for j in at[bisect_left(at, first) : bisect_right(at, last)]:
                mask |= 1 << j
        u = v & mask
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def shared_counts(arrays: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """For all pairs of sequences the size of their multiset intersection, which no alignment's matches exceed."""
    n = len(arrays)
    who = np.repeat(np.arange(n), [len(x) for x in arrays])
    what = np.concatenate(arrays).astype(np.uint64) if n else np.zeros(0, np.uint64)
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    start = np.flatnonzero(np.concatenate([[True], (what[1:] != what[:-1]) | (who[1:] != who[:-1])])) if len(what) else np.zeros(0, np.int64)
    times = np.arange(len(what)) - np.repeat(start, np.diff(np.concatenate([start, [len(what)]]))) if len(what) else np.zeros(0, np.int64)
    _, column, count = np.unique((what << np.uint64(32)) | times.astype(np.uint64), return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[common] = np.arange(len(common))
    column = place[column]
    out = np.zeros((n, n), np.float32)
    for first in range(0, len(common), columns):
        at = (column >= first) & (column < first + columns)
        part = np.zeros((n, min(columns, len(common) - first)), np.float32)
        part[who[at], column[at] - first] = 1
        out += part @ part.T
    return out.astype(np.int64)
