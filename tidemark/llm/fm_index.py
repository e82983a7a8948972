"""A compressed FM-index over integer symbols: Burrows-Wheeler transform in a wavelet matrix, in numpy."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: 64 bits a word and a running count for each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma - 1).bit_length())
        cur = symbols.astype(np.int64)
        for k in range(self.depth - 1, -1, -1):
            bit = (cur >> k) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            cur = np.r_[cur[bit == 0], cur[bit == 1]]
        self.first = self._follow(np.arange(sigma), np.zeros(sigma, np.int64))

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(at).astype(np.int64)
            at = np.where((symbol >> (self.depth - 1 - level)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._follow(symbol, at) - self.first[symbol]


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes of `text`, where symbol 0 ends a sequence and ends are ordered by place: by prefix doubling.

    No sequence has over `longest` symbols, so log2(longest) rounds tell all suffixes apart.
    """
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
    step = 1
    while True:
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-step] = rank[step:] + 1
        key = rank * (int(nxt.max()) + 1) + nxt
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        if step > longest or rank[order[-1]] == len(text) - 1:
            return order
        step *= 2


class FMIndex:
    """Over sequences of symbols 1 .. sigma-1, in the order given."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray, sigma: int):
        """`sequences`: the symbols of all sequences, one after another."""
        ends = np.cumsum(lengths)
        self.text = np.insert(sequences.astype(np.int64), ends, 0)
        self.suffixes = suffix_array(self.text, int(lengths.max(initial=0)) + 1)
        self.bwt = WaveletMatrix(self.text[self.suffixes - 1], sigma)
        self.smaller = np.r_[0, np.cumsum(np.bincount(self.text, minlength=sigma))]

    def matching(self, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics by backward search from each place `ends` (the last symbol of a pattern) of the text.

        Gives, up to `threshold`, the length to which the symbols up to that place also occur elsewhere, and the
        suffix interval [low, high) of the threshold-long pattern (empty where the length is less).
        """
        n = len(ends)
        symbol = self.text[ends]
        low, high = self.smaller[symbol], self.smaller[symbol + 1]
        length = np.where(high - low > 1, 1, 0)
        live = np.flatnonzero(length)
        for back in range(1, threshold):
            if not len(live):
                break
            at = ends[live] - back
            live = live[(at >= 0) & (self.text[at] > 0)]  # patterns end where their sequence begins
            symbol = self.text[ends[live] - back]
            both = self.bwt.rank(np.r_[symbol, symbol], np.r_[low[live], high[live]]) + np.tile(self.smaller[symbol], 2)
            low[live], high[live] = both[: len(live)], both[len(live) :]
            live = live[high[live] - low[live] > 1]
            length[live] = back + 1
        out_low, out_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        out_low[live], out_high[live] = low[live], high[live]
        return length, out_low, out_high

    def first_place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least text place in each suffix interval; intervals are equal or apart."""
        starts, back = np.unique(low, return_inverse=True)
        stops = np.zeros(len(starts), np.int64)
        stops[back] = high
        bounds = np.c_[starts, stops].ravel()
        padded = np.r_[self.suffixes, np.iinfo(np.int64).max]
        return np.minimum.reduceat(padded, bounds)[::2][back]
