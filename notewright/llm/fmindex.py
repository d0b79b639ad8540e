"""A compressed full-text index: Burrows-Wheeler transform in a wavelet matrix, searched backward.

The text is a run of records, each closed by its own separator, so no match crosses a record. Rank queries go
through a wavelet matrix of packed bits with block counts, vectorised over many patterns at once: all patterns
of a batch take a step to the left together.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over an integer sequence; about log2(alphabet) bits per symbol and a half more for the counts."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        n = len(seq)
        self.words, self.blocks, self.zeros = [], [], []
        cur = seq.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros((-n) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])[:-1].astype(np.int32))
            zero = bit == 0
            self.zeros.append(int(zero.sum()))
            cur = np.concatenate([cur[zero], cur[~zero]])
        symbols = np.arange(n_symbols)
        self.first = self._descend(symbols, np.zeros(n_symbols, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.blocks[k][word] + np.bitwise_count(self.words[k][word] & below)
            at = np.where((symbols >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbols, at) - self.first[symbols]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text in order, by doubling the compared length until all differ. The text's last symbol
    must occur once."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.ones(n, bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all() or step >= n:
            return order
        step *= 2


class FMIndex:
    """Index over records: `symbols` (any integers) one after the other, cut at `offsets`."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        m = len(offsets) - 1
        self.alphabet, dense = np.unique(symbols, return_inverse=True)
        lens = np.diff(offsets)
        record = np.repeat(np.arange(m), lens)
        at = np.arange(len(symbols)) + record  # one separator after each record
        text = np.empty(len(symbols) + m, np.int64)
        text[at] = dense + m  # separators rank by their record, below all symbols
        text[offsets[1:] + np.arange(m)] = np.arange(m)
        order = suffix_order(text) if len(text) else np.zeros(0, np.int64)
        self.suffixes = order.astype(np.int32 if len(text) < 2**31 else np.int64)
        flat = np.maximum(text - m + 1, 0)  # to the search all separators are 0
        n_symbols = len(self.alphabet) + 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=n_symbols))])
        self.bwt = WaveletMatrix(flat[order - 1] if len(text) else flat, n_symbols)

    def encode(self, patterns: np.ndarray) -> np.ndarray:
        """Symbols as the index counts them; -1 for those that it does not hold."""
        if not len(self.alphabet):
            return np.full(len(patterns), -1)
        at = np.minimum(np.searchsorted(self.alphabet, patterns), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == patterns, at + 1, -1)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol on the left."""
        start = self.starts[symbol]
        return start + self.bwt.rank(symbol, low), start + self.bwt.rank(symbol, high)

    def maximal_matches(self, patterns: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, start in the pattern, length, place in the text) of the matches that cover each pattern
        from right to left: each is extended to the left until its interval is empty, then the next begins.
        All patterns go on together, so the steps are those of the longest."""
        code = self.encode(patterns)
        at = offsets[1:].astype(np.int64) - 1
        alive = np.flatnonzero(at >= offsets[:-1])
        low, high, length = (np.zeros(len(at), np.int64) for _ in range(3))
        found: list[tuple[np.ndarray, ...]] = []

        def close(who: np.ndarray) -> None:
            who = who[length[who] > 0]
            if len(who):
                found.append((who, at[who] + 1 - offsets[who], length[who], self.suffixes[low[who]].astype(np.int64)))
                length[who] = 0

        while len(alive):
            s = code[at[alive]]
            known, fresh = s > 0, length[alive] == 0
            going = alive[known & ~fresh]
            if len(going):
                a, b = self.step(code[at[going]], low[going], high[going])
                goes_on = a < b
                close(going[~goes_on])
                on = going[goes_on]
                low[on], high[on] = a[goes_on], b[goes_on]
                length[on] += 1
            close(alive[~known])
            new = alive[known]
            new = new[length[new] == 0]
            low[new], high[new] = self.starts[code[at[new]]], self.starts[code[at[new]] + 1]
            length[new] = 1
            at[alive] -= 1
            done = at[alive] < offsets[:-1][alive]
            close(alive[done])
            alive = alive[~done]
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
