"""A compressed full-text index of word sequences: wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with running counts: rank by one popcount."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 2, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """Rank of any symbol in a sequence, a level for each bit."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for bit in reversed(range(max(1, (size - 1).bit_length()))):
            one = (symbols >> bit) & 1
            zeros = int(len(symbols) - one.sum())
            self.levels.append((bit, Bits(one.astype(np.uint8)), zeros))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])
        self.base = self.place(np.arange(size), np.zeros(size, np.int64))

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.place(symbol, at) - self.base[symbol]


class FMIndex:
    """Texts (each at most ``2 * length`` words) with an owner; finds, for windows of ``length`` words, the least owner."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, length: int):
        sizes = np.array([len(t) for t in texts])
        flat = np.concatenate(texts)
        self.vocabulary, codes = np.unique(flat, return_inverse=True)
        n, count = len(flat) + len(texts), len(texts)
        self.length, self.size = length, n
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = codes + 1
        # The end of each text is a symbol of its own, below all words, so no match runs over it.
        first = np.where(inside, text + count - 1, 0)
        first[ends] = np.arange(count)
        rank, order, step, half = first, None, 1, 1
        while half * 2 <= length:
            half *= 2
        kept = None
        while True:
            if step == half:
                kept = rank
            key = rank * (n + count + 1) + np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])[:n]
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            step *= 2
            if rank[order[-1]] == n - 1 and step > half or step > 4 * length:
                break
        self.order = order
        owner = np.repeat(owners, sizes + 1)
        self.least = np.minimum.reduceat(owner[order], starts := self._classes(kept, order, length, half))
        self.of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        shorter = self._classes(kept, order, length - 1, half)
        edge = np.r_[shorter, n]
        which = np.repeat(np.arange(len(shorter)), np.diff(edge))
        self.low, self.high = edge[which], edge[which + 1]
        before = np.where(order > 0, text[order - 1], 0)
        self.wavelet = Wavelet(before, len(self.vocabulary) + 1)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1))])

    @staticmethod
    def _classes(kept: np.ndarray, order: np.ndarray, length: int, half: int) -> np.ndarray:
        """Where, in suffix order, the first ``length`` words change: two overlapping known halves tell."""
        n = len(order)
        tail = np.minimum(order + length - half, n - 1)
        return np.flatnonzero(np.r_[True, (kept[order][1:] != kept[order][:-1]) | (kept[tail][1:] != kept[tail][:-1])])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward-search step: the intervals of the matches with ``symbol`` before them."""
        start = self.smaller[symbol]
        return start + self.wavelet.rank(symbol, low), start + self.wavelet.rank(symbol, high)

    def statistics(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each text, for each of its windows, the least owner of an equal window (-1: none).

        All texts are streamed together from their ends.  A match is kept no
        longer than the window: it is cut to one word less (the interval of
        that class of suffixes) before the next word is put in front.
        """
        sizes = np.array([len(t) for t in texts])
        known = np.searchsorted(self.vocabulary, flat := np.concatenate(texts))
        known = np.minimum(known, len(self.vocabulary) - 1)
        codes = np.where(self.vocabulary[known] == flat, known + 1, 0)
        ends = np.cumsum(sizes)
        found = np.full(len(flat), -1, np.int64)
        low, high = np.zeros(len(texts), np.int64), np.full(len(texts), self.size)
        matched = np.zeros(len(texts), np.int64)
        for t in range(1, int(sizes.max()) + 1):
            at = np.flatnonzero(sizes >= t)
            place = ends[at] - t
            symbol = codes[place]
            full = matched[at] >= self.length
            low[at[full]], high[at[full]] = self.low[low[at[full]]], self.high[low[at[full]]]
            matched[at[full]] = self.length - 1
            a, b = self.extend(symbol, low[at], high[at])
            hit = (a < b) & (symbol > 0)
            # A text that is itself indexed always matches; any other starts again behind a mismatch.
            low[at], high[at] = np.where(hit, a, 0), np.where(hit, b, self.size)
            matched[at] = np.where(hit, matched[at] + 1, 0)
            done = at[hit & (matched[at] >= self.length)]
            found[ends[done] - t] = self.least[self.of[low[done]]]
        return [found[e - s : max(e - self.length + 1, e - s)] for s, e in zip(sizes, ends, strict=True)]
