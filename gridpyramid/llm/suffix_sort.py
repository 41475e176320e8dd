"""Suffix mergesort whose comparisons use prefix polynomial hashes.

The hash of any substring follows from two prefix hashes, so a binary search
over lengths finds how far two suffixes agree in a logarithmic number of
steps; the next byte then decides. The sort is a bottom-up mergesort whose
steps work on whole arrays. Where it says that two suffixes agree up to the
limit, their bytes are compared.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64


#: The prime modulus: no text of a special form collides for every base, as they do modulo a power of two.
PRIME = U(2**61 - 1)
CHUNK = 1 << 16


def _folded(x: np.ndarray) -> np.ndarray:
    """Numbers under 2**64 modulo the prime."""
    x = (x & PRIME) + (x >> U(61))
    return np.minimum(x, x - PRIME)  # below the prime, the difference wraps around to a large number


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, by halves of 31 bits, so that nothing leaves 64 bits."""
    half = U(2**31 - 1)
    a1, a0, b1, b0 = a >> U(31), a & half, b >> U(31), b & half
    middle = a1 * b0 + a0 * b1
    return _folded(((a1 * b1) << U(1)) + (middle >> U(30)) + ((middle & U(2**30 - 1)) << U(31)) + a0 * b0)


@lru_cache(maxsize=8)
def _tables(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, int(PRIME), 256, dtype=U), int(rng.integers(2**60, int(PRIME)))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo the prime."""
    known = _POWERS.get(seed)
    if known is None or len(known[0]) < n:
        base, out = _tables(seed)[1], []
        for factor in (base, pow(base, -1, int(PRIME))):
            p = np.ones(n, U)
            have = 1
            while have < n:
                size = min(have, n - have, CHUNK)
                p[have : have + size] = _product(p[:size], U(pow(factor, have, int(PRIME))))
                have += size
            out.append(p)
        if n > 1 << 23:  # a very long text: not kept
            return out[0], out[1]
        known = _POWERS[seed] = (out[0], out[1])
    return known


class PrefixHash:
    """Hashes of all substrings of a byte array, in chunks that fit a core's cache."""

    def __init__(self, data: np.ndarray, seed: int):
        n = len(data)
        power, self.inverse = _powers(seed, n + 1)
        values = _tables(seed)[0]
        self.prefix = np.zeros(n + 1, U)
        for i in range(0, n, CHUNK):
            terms = _product(values[data[i : i + CHUNK]], power[i : min(i + CHUNK, n)])
            low, high = np.cumsum(terms & U(2**32 - 1)), np.cumsum(terms >> U(32))
            sums = (high >> U(29)) + ((high & U(2**29 - 1)) << U(32)) + low
            self.prefix[i + 1 : i + 1 + len(terms)] = _folded(sums + self.prefix[i])

    def _between(self, low: np.ndarray, high: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        return _product(_folded(high + (PRIME - low)), inverse)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return self._between(self.prefix[start], self.prefix[start + length], self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length, by start."""
        n = max(0, len(self.prefix) - length)
        out = np.empty(n, U)
        for i in range(0, n, CHUNK):
            end = min(i + CHUNK, n)
            out[i:end] = self._between(self.prefix[i:end], self.prefix[i + length : end + length], self.inverse[i:end])
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def _head(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """The first bytes of each suffix as one number, in the order of the bytes."""
    out = np.zeros(len(start), U)
    for i in range(size):
        out = (out << U(8)) | data[start + i].astype(U)
    return out


def common(hashes: PrefixHash, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common extension of the suffixes at a and b, up to the limit."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
    for _ in range(int(limit).bit_length()):
        middle = (low + high + 1) >> 1
        same = hashes.of(a, middle) == hashes.of(b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        high = np.maximum(low, high)
    return low


def suffix_order(data: np.ndarray, hashes: PrefixHash, start: np.ndarray, limit: int) -> np.ndarray:
    """The stable order of the suffixes by their first limit bytes, all of which exist."""
    n = len(start)
    head = _head(data, start, min(8, limit))
    order = np.arange(n)

    def before(x, y, or_equal):
        """Whether suffix x sorts before suffix y."""
        less = head[x] < head[y]
        tie = np.flatnonzero(head[x] == head[y])
        if len(tie):
            a, b = start[x[tie]], start[y[tie]]
            same = common(hashes, a, b, limit)
            at = np.minimum(same, limit - 1)
            less[tie] = np.where(same >= limit, or_equal, data[a + at] < data[b + at])
        return less

    width = 1
    while width < n:
        place = np.arange(n)
        run = place // width
        other = run ^ 1
        first, last = np.minimum(other * width, n), np.minimum((other + 1) * width, n)
        is_left = run % 2 == 0
        low, high = first.copy(), last.copy()
        while True:  # how many of the other run go before each element
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            mine, theirs = order[open_], order[middle]
            goes = np.empty(len(open_), bool)
            left = is_left[open_]
            goes[left] = before(theirs[left], mine[left], False)
            goes[~left] = before(theirs[~left], mine[~left], True)
            low[open_] = np.where(goes, middle + 1, low[open_])
            high[open_] = np.where(goes, high[open_], middle)
        target = np.minimum(run, other) * width + (place - run * width) + (low - first)
        merged = np.empty_like(order)
        merged[target] = order
        order, width = merged, 2 * width
    return order


def classes(data: np.ndarray, hashes: PrefixHash, start: np.ndarray, limit: int) -> np.ndarray:
    """A number for each suffix, equal where the first limit bytes are equal."""
    if not len(start):
        return np.zeros(0, np.int64)
    order = suffix_order(data, hashes, start, limit)
    a, b = start[order[:-1]], start[order[1:]]
    same = hashes.of(a, limit) == hashes.of(b, limit)
    check = np.flatnonzero(same)
    for i in range(0, len(check), 50_000):  # the bytes have the last word
        part = check[i : i + 50_000]
        reach = np.arange(limit)
        same[part] = (data[a[part][:, None] + reach] == data[b[part][:, None] + reach]).all(1)
    out = np.empty(len(start), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(~same)))
    return out
