"""Numpy kernels over batches of texts: words, rolling fingerprints, minimal anchors.

Fingerprints are polynomials modulo 2**64 over randomly mapped symbols, finished by
a mixer. Blocks have a few dozen to a few hundred symbols.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 18
SEGMENT = 1 << 22

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), CHUNK * 2)
        _powers = np.full(size, BASE, np.uint64)
        _powers[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        _inverses = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        _inverses[0] = 1
        np.multiply.accumulate(_inverses, out=_inverses)
    return _powers, _inverses


class Rolling:
    """Fingerprints of any slice of a symbol array."""

    def __init__(self, codes: np.ndarray):
        p, self.inv = _tables(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * p[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inv[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    m, s, n = a, 1, len(a) - w + 1
    if n <= 0:
        return a[:0]
    while 2 * s <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return m if s == w else np.minimum(m[:n], m[w - s : w - s + n])


class Words:
    """Words of several byte strings: buffer, starts, ends, document of each word, first word of each document."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        self.doc_start = np.concatenate([[1], 1 + np.cumsum(lengths + 1)]).astype(np.int64)
        gap = _SEPARATOR[self.buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.doc_start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return Rolling(BYTE_CODE[self.buf]).of(self.start, self.end) | U(1)


def chunks(rows: list[tuple], size=len) -> list[list[tuple]]:
    """Rows whose last field is bytes, in lists of about CHUNK bytes; a longer text stands alone."""
    out, held, total = [], [], 0
    for r in rows:
        held.append(r)
        total += len(r[-1])
        if total >= CHUNK:
            out.append(held)
            held, total = [], 0
    return [*out, held] if held else out


def runs(starts: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal disjoint runs."""
    if not len(starts):
        return starts, starts
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate((starts + widths)[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    at = np.flatnonzero(new)
    return s[at], e[np.concatenate([at[1:] - 1, [len(s) - 1]])]


def anchors(codes: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Units of windows with a common anchor: ``(anchor hash, context hash, document, first window, windows)``.

    The anchor of a window of ``length`` symbols is its leftmost least ``gram``; equal
    windows have their anchors at equal offsets. ``bounds`` delimits documents in
    ``codes``; windows never cross them, and positions are relative to a document.
    """
    span = length - gram + 1
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(codes) < length:
        return empty
    roll = Rolling(codes)
    g = roll.grams(gram)
    low = U((1 << 26) - 1)
    place = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    at = (sliding_min(place, span) & low).astype(np.int64)
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))[: len(at)]
    ok = np.arange(len(at)) + length <= bounds[1:][doc]
    w = np.flatnonzero(ok)
    if not len(w):
        return empty
    a, d = at[w], doc[w]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]))
    s0 = w[first]
    s1 = w[np.concatenate([first[1:] - 1, [len(w) - 1]])]
    a = a[first]
    shape = ((a - s0) * 65536 + (s1 - s0)).astype(np.uint64)
    context = mix(roll.of(s0, s1 + length) + shape * U(BASE))
    d = d[first]
    return g[a], context, d, s0 - bounds[d], s1 - s0 + 1


def segments(n: int, length: int) -> list[tuple[int, int]]:
    """Cuts of a long symbol array into parts that share length - 1 symbols, so each window lies in just one."""
    return [(i, min(n, i + SEGMENT + length - 1)) for i in range(0, max(1, n - length + 1), SEGMENT)]
