"""Words of many texts at once: where they are in the UTF-8 bytes and a 64-bit hash of each, without a Python object per word.

A word is a maximal run of bytes other than space and tab to carriage return; A-Z count as a-z in its hash. The hash of a word is a
polynomial over 64-bit values of its bytes, taken from running sums over the whole batch and mixed at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Bytes worked on at a time; a longer word is taken whole.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_UNIT = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]

_powers: dict[int, np.ndarray] = {}


def _ladder(unit: int, count: int) -> np.ndarray:
    """unit**0, unit**1, ... modulo 2**64."""
    have = _powers.get(unit)
    if have is None or len(have) < count:
        grown = np.ones(1, np.uint64)
        while len(grown) < max(count, PIECE + 1):
            grown = np.concatenate([grown, grown * np.uint64(pow(unit, len(grown), 1 << 64))])
        have = grown
        if count <= 2 * PIECE:
            _powers[unit] = have
    return have[:count]


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2**64, and those of its inverse: with sums of ``value * up``, stretches get hashes free of their place."""
    return _ladder(_BASE, count), _ladder(_UNIT, count)


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values, so that any bits of them may serve as a bucket."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def find_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of all texts, and for text i its words as ``firsts[i]:firsts[i + 1]``."""
    hashes, starts, ends = [], [], []
    at, total = 0, len(raw)
    while at < total:
        to = min(at + PIECE, total)
        if to < total:
            to = _cut(raw, bounds, at, to)
        h, s, e = _piece(raw[at:to], bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, to)] - at)
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, bounds)


def _cut(raw: np.ndarray, bounds: np.ndarray, at: int, to: int) -> int:
    """A place for the end of a piece that is inside no word: the last one up to ``to``, or else the first after it."""
    edge = int(bounds[np.searchsorted(bounds, to, side="right") - 1])
    gaps = np.flatnonzero(SPACE[raw[max(at, to - 65536) : to]])
    inside = max(edge, max(at, to - 65536) + int(gaps[-1]) + 1 if len(gaps) else at)
    if inside > at:
        return inside
    after = int(bounds[np.searchsorted(bounds, to)])
    while to < after:
        gaps = np.flatnonzero(SPACE[raw[to : min(to + 65536, after)]])
        if len(gaps):
            return to + int(gaps[0])
        to = min(to + 65536, after)
    return after


def _piece(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = SPACE[raw]
    fresh = np.ones(len(raw) + 1, bool)  # nothing of the same text stands before this byte
    fresh[1:-1] = False
    fresh[breaks] = True
    begins = ~blank
    begins[1:] &= blank[:-1] | fresh[1:-1]
    closes = ~blank
    closes[:-1] &= blank[1:] | fresh[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * _ladder(_BASE, len(raw)), out=sums[1:])
    return mixed((sums[end] - sums[start]) * _ladder(_UNIT, len(raw))[start]), start, end


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in ascending order, where each stands first, and which of them each hash is: as ``np.unique`` gives them, but only the distinct ones are sorted."""
    codes, values = pd.factorize(hashes)
    first = np.zeros(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(hashes))[::-1]
    order = np.argsort(values)
    rank = np.zeros(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return values[order], first[order], rank[codes]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row, over the whole batch; those that cross texts are for the caller to leave out."""
    count = max(0, len(hashes) - size + 1)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + count]
    return mixed(out)
