"""Hashes of words and of word shingles, for whole Arrow batches at once.

Text is lower-cased for A-Z and cut into words at ASCII white space. A word's hash is a polynomial in its bytes modulo
2**64, taken from running sums and then mixed; a shingle's hash mixes the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes handled at a time (a longer text is handled whole).
AT_ONCE = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_power: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(max(n, AT_ONCE) + 1, base, dtype=np.uint64)
            x[0] = 1
            _power[name] = np.cumprod(x)
    return _power["up"], _power["down"]


def pieces(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts [i, j) of about AT_ONCE bytes."""
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + AT_ONCE, side="right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words of the texts data[off[i]:off[i+1]], and each text's first word; space marks the bytes between words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(U), z, z, np.zeros(len(off), np.int64)
    gap = space[data]
    at_start = np.zeros(n + 1, bool)
    at_start[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    starts = np.flatnonzero(~gap & (before | at_start[:-1]))
    ends = np.flatnonzero(~gap & (after | at_start[1:])) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, starts, ends, np.searchsorted(starts, off)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts end to end, repeats kept, and each text's first one.

    A text with 1 to k - 1 words has one shingle, of all of them; one without words has none.
    """
    counts = first[1:] - first[:-1]
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    where = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(where[-1], dtype=np.uint64)
    full = counts >= k
    if full.any():
        h = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
        for j in range(k):
            h *= _BASE
            h += hashes[j : len(hashes) - k + 1 + j]
        take = np.zeros(len(h) + 1, dtype=np.int64)  # +1 where a text's shingles start, -1 where they end
        np.add.at(take, first[:-1][full], 1)
        np.add.at(take, (first[1:] - k + 1)[full], -1)
        mine = np.cumsum(take[:-1]) > 0
        to = np.ones(where[-1], bool)
        to[where[:-1][(per == 1) & ~full]] = False
        out[to] = mix(h[mine])
    for i in np.flatnonzero((per == 1) & ~full):
        own = int(counts[i])
        for x in hashes[first[i] : first[i + 1]].tolist():
            own = (own * int(_BASE) + x) & 0xFFFFFFFFFFFFFFFF
        out[where[i]] = mix(np.array([own ^ int(_INVERSE)], dtype=np.uint64))[0]
    return out, where
