"""An FM-index over a shard of words: suffix order, wavelet-tree ranks, sampled positions.

Symbol 0 stands for a word that no pattern holds or for the end of a document. Every 0
counts as a symbol of its own, ordered by position, so no match runs over one and the
suffixes of ordinary text differ after a few words.
"""

from __future__ import annotations

import numpy as np


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """The rank of each suffix, by doubling the compared length; sorts only what is still tied.

    The last symbol must be 0. A rank is the place in the sorted order where the
    suffix's group begins, so it is final once the group has one member.
    """
    n = len(symbols)
    ranks = np.empty(n, np.int64)
    border = symbols == 0
    n_border = int(border.sum())
    ranks[border] = np.arange(n_border)
    sizes = np.bincount(symbols[~border])
    ranks[~border] = (n_border + np.cumsum(sizes) - sizes)[symbols[~border]]
    tied = np.flatnonzero(~border & (sizes[symbols] > 1)) if len(sizes) else np.empty(0, np.int64)
    step = 1
    while len(tied):
        key = ranks[tied] * n + ranks[tied + step]
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        old = ranks[tied]
        place = np.arange(len(tied))
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        fresh = np.r_[True, key[1:] != key[:-1]]
        run = np.maximum.accumulate(np.where(fresh, place, 0))
        ranks[tied] = old + run - group
        alone = fresh & np.r_[fresh[1:], True]
        tied = tied[~alone]
        step *= 2
    return ranks


class BitRank:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = 8):
        n = len(symbols)
        suffixes = np.empty(n, np.int64)
        suffixes[suffix_ranks(symbols)] = np.arange(n)
        before = symbols[suffixes - 1]
        self.size = n
        sizes = np.bincount(symbols, minlength=n_symbols)
        self.first = np.cumsum(sizes) - sizes
        marked = (suffixes % sample == 0) | (before == 0)  # a walk never steps over a 0
        self.marks, self.places = BitRank(marked), suffixes[marked]
        self.levels: list[tuple[int, BitRank, int]] = []
        for level in range(max(1, (n_symbols - 1).bit_length()) - 1, -1, -1):
            bits = (before >> level & 1).astype(bool)
            self.levels.append((level, BitRank(bits), int(n - bits.sum())))
            before = np.concatenate([before[~bits], before[bits]])
        self.start = self.descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` falls on the lowest level of the wavelet tree along the bits of ``symbol``."""
        for level, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One backward-search step of an end of an interval."""
        return self.first[symbol] + self.descend(symbol, at) - self.start[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each pattern (rows of equal length)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j]
            low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the sorted order, by walking back to a sampled one."""
        found = np.empty(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            here = self.marks.bit(at)
            found[live[here]] = self.places[self.marks.ones(at[here])] + steps
            live, at = live[~here], at[~here]
            symbol = np.zeros(len(at), np.int64)
            for level, bits, zeros in self.levels:
                one, ones = bits.bit(at), bits.ones(at)
                symbol |= one.astype(np.int64) << level
                at = np.where(one, zeros + ones, at - ones)
            at = self.first[symbol] + at - self.start[symbol]
            steps += 1
        return found
