"""FM-index over a sequence of words.

Suffix order by prefix doubling on the groups that are still tied, the
Burrows-Wheeler transform in a wavelet matrix with popcount ranks, backward
search for many patterns at once, and locating by walking to sampled suffix
positions. All steps are array operations.
"""

from __future__ import annotations

import numpy as np


class Ranks:
    """Bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % 64 + 64, np.uint8)
        self.words = np.packbits(np.concatenate([bits.astype(np.uint8), pad]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int):
        self.levels: list[tuple[int, Ranks, int]] = []
        for b in reversed(range(max(1, int(top).bit_length()))):
            bits = (values >> b & 1).astype(bool)
            zeros = values[~bits]
            self.levels.append((b, Ranks(bits), len(zeros)))
            values = np.concatenate([zeros, values[bits]])

    def rank(self, c: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of symbol c[i] before each of the given ends."""
        at = [np.zeros_like(ends[0]), *ends]
        for b, ranks, zeros in self.levels:
            one = (c >> b & 1).astype(bool)
            for k, i in enumerate(at):
                ones = ranks.ones(i)
                at[k] = np.where(one, zeros + ones, i - ones)
        return [x - at[0] for x in at[1:]]


def suffix_order(rank: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order. rank: symbols of which the last of each record occurs once in all."""
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    keys = rank[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = ~(first & np.concatenate([first[1:], [True]]))
    slots = np.flatnonzero(tied)
    width = 1
    while len(slots):
        at = order[slots]
        keys = rank[at] * (n + 1) + rank[at + width]
        by = np.argsort(keys, kind="stable")
        at, keys = at[by], keys[by]
        order[slots] = at  # a group holds consecutive slots, so sorting all tied ones keeps each in its group
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[at] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        slots = slots[~(first & np.concatenate([first[1:], [True]]))]
        width *= 2
    return order


class FMIndex:
    """Over records of symbols 1..top; 0 ends each record."""

    SAMPLE = 16

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        ends = symbols == 0
        n_ends = int(ends.sum())
        order = suffix_order(np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + n_ends))
        self.bwt = symbols[order - 1].astype(np.int64)
        self.wavelet = WaveletMatrix(self.bwt, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        starts = np.concatenate([[True], ends[:-1]])  # a walk never has to pass the end of a record
        sampled = (order % self.SAMPLE == 0) | starts[order]
        self.marked = sampled
        self.samples = order[sampled]
        self.sampled_before = Ranks(sampled)
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern. patterns: rows padded at the left with 0."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, patterns.shape[1] - 1 - step]
            a, b = self.wavelet.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.before[c] + a, self.before[c] + b
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the range, position) of every suffix in the ranges."""
        size = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(lo)), size)
        row = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which]
        steps = np.zeros(len(row), np.int64)
        while len(live := np.flatnonzero(~self.marked[row])):
            c = self.bwt[row[live]]
            (a,) = self.wavelet.rank(c, row[live])
            row[live] = self.before[c] + a
            steps[live] += 1
        return which, self.samples[self.sampled_before.ones(row)] + steps
