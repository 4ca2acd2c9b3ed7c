"""An FM-index over a sequence of integer symbols, in NumPy: wavelet-tree ranks and sampled suffix positions.

Symbol 0 separates runs and is never searched. Each separator sorts as a symbol of its own, so no
comparison goes beyond a run and the number of sorting rounds is the logarithm of the longest run.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank: packed words and the count of ones before each."""

    def __init__(self, flags: np.ndarray) -> None:
        packed = np.packbits(flags, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, dtype=np.uint8)]).view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.cumsum(ones, dtype=np.int64) - ones
        self.ones = int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in [0, i)."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Rank and access over a sequence of symbols, one bit vector a level (the levels in the order of a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        now = symbols
        for k in range(self.depth - 1, -1, -1):
            bit = (now >> k & 1).astype(bool)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])
        self.starts = self._descend(np.arange(n_symbols), np.zeros(n_symbols, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.rank(i)
            i = np.where(symbol >> k & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in [0, i)."""
        return self._descend(symbol, i) - self.starts[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its occurrences before i."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for bits, zeros in self.levels:
            bit, ones = bits.get(i), bits.rank(i)
            symbol = symbol << 1 | bit
            i = np.where(bit, zeros + ones, i - ones)
        return symbol, i - self.starts[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of text in the order of their suffixes, by prefix doubling; text ends with a separator."""
    separator = text == 0
    n_sep = int(separator.sum())
    rank = np.where(separator, np.cumsum(separator) - 1, text.astype(np.int64) + n_sep - 1)
    k, n = 1, len(text)
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(n - k, 0)] = rank[k:] + 1
        # a separator's rank is its own, so what follows it doesn't matter
        key = rank * (rank.max() + 2) + np.where(rank < n_sep, 0, ahead)
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Occurrences of patterns in text (symbols 1 to n_symbols - 1; 0 separates runs)."""

    def __init__(self, text: np.ndarray, n_symbols: int, every: int = 8) -> None:
        text = text if len(text) and text[-1] == 0 else np.append(text, 0)
        order = suffix_order(text)
        before = np.where(order > 0, text[order - 1], 0)
        self.size, self.tree = len(text), WaveletTree(before, n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])[:-1]
        # the walk to a sample never passes a run's first symbol
        sampled = (order % every == 0) | (before == 0)
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix rows [low, high) that begin with each pattern (patterns x length), by backward search."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.size, dtype=np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            low[alive], high[alive] = self.first[c] + self.tree.rank(c, low[alive]), self.first[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back in the text until a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        open_ = np.flatnonzero(~self.sampled.get(at))
        while len(open_):
            symbol, before = self.tree.access(at[open_])
            at[open_] = self.first[symbol] + before
            steps[open_] += 1
            open_ = open_[~self.sampled.get(at[open_])]
        return self.positions[self.sampled.rank(at)] + steps
