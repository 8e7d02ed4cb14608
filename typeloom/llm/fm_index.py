"""FM-index over runs of symbols: suffix array, Burrows-Wheeler transform, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``t`` by prefix doubling; ties are re-sorted only where they remain."""
    n = len(t)
    sa = np.argsort(t, kind="stable")
    head = np.ones(n, bool)
    head[1:] = t[sa][1:] != t[sa][:-1]
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    k = 1
    while True:
        single = head.copy()
        single[:-1] &= head[1:]
        at = np.flatnonzero(~single)
        if not len(at):
            return sa
        pos, own = sa[at], group[at]
        after = np.where(pos + k < n, rank[np.minimum(pos + k, n - 1)] + 1, 0)
        key = own * (n + 2) + after
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        sa[at] = pos
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        head[at] = new
        group[at] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[pos] = group[at]
        k *= 2


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros((len(bits) >> 6) + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), np.int64)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w, low = i >> 6, (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)).astype(np.int64) & 1


class WaveletTree:
    """Symbol ranks over a sequence; the levels lie one after another, most significant bit first."""

    def __init__(self, a: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bit = (a >> level) & 1
            self.levels.append(Bits(bit.astype(bool)))
            self.zeros.append(int(len(a) - bit.sum()))
            a = np.concatenate([a[bit == 0], a[bit == 1]])
        self.first = self._down(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, z) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(i)
            i = np.where((c >> (self.depth - 1 - k)) & 1, z + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before place i."""
        return self._down(c, i) - self.first[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i and its rank there."""
        c = np.zeros(len(i), np.int64)
        for bits, z in zip(self.levels, self.zeros):
            bit, ones = bits.get(i), bits.rank(i)
            c = 2 * c + bit
            i = np.where(bit, z + ones, i - ones)
        return c, i - self.first[c]


class FMIndex:
    """Index over runs (sequences of symbols from 1 to sigma); patterns never match across runs."""

    def __init__(self, symbols: np.ndarray, run_offs: np.ndarray, sigma: int, sample: int = 8):
        runs = len(run_offs) - 1
        length = np.diff(run_offs)
        n = len(symbols) + runs
        ends = run_offs[1:] + np.arange(runs)  # a sentinel of its own closes each run
        t = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        t[inside] = symbols + runs - 1
        t[ends] = np.arange(runs)
        sa = suffix_array(t)
        before = t[sa - 1]
        bwt = np.where(before >= runs, before - runs + 1, 0)
        self.n, self.tree = n, WaveletTree(bwt, sigma)
        self.below = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=sigma + 1)[: sigma + 1], out=self.below[1:])
        self.below += runs  # self.below[c]: suffixes that begin with a smaller symbol
        place = np.arange(n) - np.repeat(np.concatenate([[0], ends[:-1] + 1]), length + 1)
        kept = (place[sa] % sample == 0) & inside[sa]
        self.marked, self.samples = Bits(kept), (sa - np.searchsorted(ends, sa))[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: for each pattern its first and past-the-last row (equal: none). Rows are padded with 0."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1):
            alive = alive[lengths[alive] >= back]
            if not len(alive):
                break
            c = patterns[alive, lengths[alive] - back]
            lo[alive] = self.below[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.below[c] + self.tree.rank(c, hi[alive])
            gone = lo[alive] >= hi[alive]
            hi[alive[gone]] = lo[alive[gone]]
            alive = alive[~gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in ``symbols`` at which the rows' suffixes begin; steps back to the nearest sample."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            hit = self.marked.get(at) == 1
            out[todo[hit]] = self.samples[self.marked.rank(at[hit])] + steps[todo[hit]]
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                c, r = self.tree.access(at)
                at = self.below[c] + r
                steps[todo] += 1
        return out
