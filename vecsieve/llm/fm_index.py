"""Substring deduplication by compressed FM-indexes.

A shard holds the distinct word contexts of some anchors (``repeats``). Its index is the
Burrows-Wheeler transform of their suffixes in a wavelet matrix of packed bits with block
counts, and every eighth place of the suffix array. Documents' contexts are streamed against
it in blocks: backward search gives each end its matching statistic, the length of the
longest match that ends there and occurs twice, and the interval of its occurrences. Where
it reaches the threshold, the least place in the interval tells which window came first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .repeats import Windows, bodies, found_table, repeated, with_ranges
from .store import Cuts, keyed, restore_id

OUT = "uid long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string, kept_sha256 string"


class PackedBits:
    """Bits in words of 64 with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """Index of pieces, each a list of symbols from 0 to ``sigma`` - 1, with the number of times each stands for."""

    SAMPLE = 8
    BLOCK = 1 << 16

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, times: np.ndarray, sigma: int):
        count = len(lengths)
        self.start = np.cumsum(lengths + 1) - lengths - 1
        owner = np.repeat(np.arange(count), lengths)
        self.text = text = np.zeros(len(symbols) + count, np.int64)
        text[np.arange(len(symbols)) + owner] = symbols + count
        text[self.start + lengths] = np.arange(count)  # each piece ends with a symbol of its own
        n, self.sigma = len(text), sigma + count
        rank, k = text, 1
        while k <= int(lengths.max(initial=0)):
            after = np.concatenate([rank[k:] + 1, np.zeros(min(k, n), np.int64)])
            rank = np.unique(rank * (n + self.sigma + 1) + after, return_inverse=True)[1]
            k *= 2
        suffix = np.argsort(rank, kind="stable")
        self.sampled = PackedBits((suffix % self.SAMPLE == 0).astype(np.uint8))
        self.places = suffix[suffix % self.SAMPLE == 0].astype(np.int32)
        weight = np.repeat(times, lengths + 1)
        self.weights = np.concatenate([[0], np.cumsum(weight[suffix])])
        last = text[suffix - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.levels = []
        for bit in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            bits = (last >> bit) & 1
            self.levels.append((bit, PackedBits(bits)))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        # where the occurrences of a symbol begin at the last level, and in the first column
        runs, at = np.unique(last, return_index=True)
        leaf = np.zeros(self.sigma, np.int64)
        leaf[runs] = at
        self.offset = self.first[: self.sigma] - leaf

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put in front."""
        lo, hi = low, high
        for bit, packed in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            b, c = packed.ones(lo), packed.ones(hi)
            lo = np.where(one, packed.zeros + b, lo - b)
            hi = np.where(one, packed.zeros + c, hi - c)
        return self.offset[symbol] + lo, self.offset[symbol] + hi

    def before(self, row: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one symbol longer."""
        symbol, at = np.zeros_like(row), row
        for _, packed in self.levels:
            b = packed.ones(at)
            one = packed.ones(at + 1) > b
            symbol = 2 * symbol + one
            at = np.where(one, packed.zeros + b, at - b)
        return self.offset[symbol] + at

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places of suffixes, by steps to the next sampled one."""
        out, todo, at = np.zeros(len(row), np.int64), np.arange(len(row)), row
        for steps in range(self.SAMPLE):
            known = self.sampled.ones(at + 1) - self.sampled.ones(at) > 0
            out[todo[known]] = self.places[self.sampled.ones(at[known])] + steps
            todo, at = todo[~known], self.before(at[~known])
        return out

    def statistics(self, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the ends of the text's prefixes, up to ``most``, with the intervals of the matches.

        A match occurs twice, counting the number of times of each piece.
        """
        stat, low, high = (np.zeros(len(end), np.int64) for _ in range(3))
        for at in range(0, len(end), self.BLOCK):
            some = end[at : at + self.BLOCK]
            alive, lo, hi = np.arange(len(some)), np.zeros(len(some), np.int64), np.full(len(some), len(self.text), np.int64)
            for back in range(1, most + 1):
                lo, hi = self.extend(self.text[some[alive] - back], lo, hi)
                more = self.weights[hi] - self.weights[lo] > 1
                alive, lo, hi = alive[more], lo[more], hi[more]
                stat[at + alive], low[at + alive], high[at + alive] = back, lo, hi
        return stat, low, high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least place in each interval; intervals are equal or disjoint."""
        lows, which, found = np.unique(low, return_index=True, return_inverse=True)
        sizes = high[which] - lows
        starts = np.cumsum(sizes) - sizes
        rows = np.repeat(lows - starts, sizes) + np.arange(int(sizes.sum()))
        return np.minimum.reduceat(self.locate(rows), starts)[found]


def _resolver(window: int):
    def resolve(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table["p"].to_numpy(), table["uid"].to_numpy()))))
        times, w = (table[k].to_numpy().astype(np.int64) for k in ("n", "w"))
        names, code = np.unique(A.Words(table["body"].to_pylist()).hashes(), return_inverse=True)
        index = FMIndex(code, w + window - 1, times, len(names))
        owner = np.repeat(np.arange(len(w)), w)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(w) - w, w)
        at = index.start[owner] + inside
        stat, low, high = index.statistics(at + window, window)
        hit = np.flatnonzero(stat >= window)
        if not len(hit):
            return found_table(table, hit, hit, np.zeros(0, bool))
        own = index.earliest(low[hit], high[hit]) == at[hit]
        told = ~own | (times[owner[hit]] > 1)
        hit, own = hit[told], own[told]
        return found_table(table, owner[hit], inside[hit], own)

    return resolve


def _strip(window: int):
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for uid, text, ranges in zip(batch["uid"].to_pylist(), bodies(batch["text"]), batch["ranges"].to_pylist()):
                words = text.split()
                at = np.array([(x["p"], x["w"]) for x in ranges or ()], np.int64).reshape(-1, 2)
                s, e = A.runs(at[:, 0], at[:, 1] + window - 1)
                edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(words)]
                left = [x for i, j in zip(edges[::2], edges[1::2]) for x in words[i:j]]
                kept = b" ".join(left)
                spans = [{"start": i, "end": j} for i, j in zip(s.tolist(), e.tolist())]
                row = (uid, len(words), len(words) - len(left), spans, kept.decode(), hashlib.sha256(kept).hexdigest())
                for column, v in zip(out, row):
                    column.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string())
            names = ["uid", "n_words", "n_removed", "spans", "kept", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    return run


def fm_index_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Remove every word inside a window of ``window`` words that also starts earlier.

    One row per input row: ``uid``'s id under its own name, ``n_words``, ``n_removed``,
    ``spans`` (removed word runs), ``kept`` (words joined by a space), ``kept_sha256``.
    Earlier means a smaller id, or an earlier word of the same document. A null text has no
    words; texts of fewer words than a window stay whole; rows that repeat an id, or have
    none, are documents of their own, ordered by (id, text), nulls first; an empty table
    gives an empty result; columns besides the id and the text are not read. ``window`` is
    at least 2. Words are compared by 64-bit fingerprints.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    cuts = Cuts(docs.sparkSession)
    rows = keyed(cuts, docs, id_col, text_col)
    spec = Windows(words=True, length=window, gram=(window + 1) // 2, keep_first=True)
    found = repeated(cuts, rows, spec, _resolver(window))
    return restore_id(cuts, with_ranges(rows, found).mapInArrow(_strip(window), OUT), rows, id_col)
