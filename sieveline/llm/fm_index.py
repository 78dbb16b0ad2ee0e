"""A compressed FM-index over words: the Burrows-Wheeler transform in a wavelet matrix, every EVERY-th place of the suffix array, backward search."""

from __future__ import annotations

import numpy as np

#: One place in so many is kept; others are found by steps through the transform.
EVERY = 8


class WaveletMatrix:
    """Rank queries over a sequence of symbols; each level holds packed bits and a count for every 64 of them."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels, self.n = [], len(sequence)
        now = sequence
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bits = (now >> shift & 1).astype(np.uint8)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(len(packed) // 8 + 2, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)])[:-1].astype(np.int32)
            ones_total = int(bits.sum())
            self.levels.append((shift, words, ones, self.n - ones_total))
            one = bits.astype(bool)
            now = np.concatenate([now[~one], now[one]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the sequence goes when only ``symbol`` is followed down; differences are ranks."""
        for shift, words, ones, zeros in self.levels:
            block = i >> 6
            before = ones[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(symbol >> shift & 1, zeros + before, i - before)
        return i


    def follow(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position i, and where i goes when it is followed down."""
        symbol = np.zeros(len(i), np.int64)
        for shift, words, ones, zeros in self.levels:
            block, bit = i >> 6, (i & 63).astype(np.uint64)
            before = ones[block] + np.bitwise_count(words[block] & ((np.uint64(1) << bit) - np.uint64(1)))
            one = (words[block] >> bit & np.uint64(1)).astype(bool)
            symbol |= one.astype(np.int64) << shift
            i = np.where(one, zeros + before, i - before)
        return symbol, i


class FMIndex:
    """Symbol 0 separates texts and is never searched."""

    def __init__(self, text: np.ndarray, symbols: int):
        suffixes = suffix_order(text)
        transform = text[suffixes - 1]
        kept = suffixes % EVERY == 0
        self.kept = WaveletMatrix(kept.astype(np.int64), 2)  # of one level: a bit map with counts
        self.samples = suffixes[kept].astype(np.int32)
        self.tree = WaveletMatrix(transform.astype(np.int64), symbols)
        counts = np.bincount(text, minlength=symbols)
        every = np.arange(symbols, dtype=np.int64)
        self.base = np.cumsum(counts) - counts - self.tree.place(every, np.zeros(symbols, np.int64))
        self.n = len(text)

    def statistics(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from each of ``ends``, all at once: how far each went while at least two places matched, and the
        suffixes that match at the end; searches stop as soon as only one place is left."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        reached, going = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for step in range(length):
            symbol = text[ends[going] - step].astype(np.int64)
            lo = self.base[symbol] + self.tree.place(symbol, low[going])
            hi = self.base[symbol] + self.tree.place(symbol, high[going])
            several = hi - lo > 1
            going = going[several]
            low[going], high[going] = lo[several], hi[several]
            reached[going] = step + 1
        return reached, low, high

    def places(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: steps back through the transform until a position that was kept (0 always is)."""
        found, going, now, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(going):
            is_kept, rank = self.kept.follow(now)
            done = is_kept == 1
            found[going[done]] = self.samples[rank[done] - self.kept.levels[0][3]] + steps
            going, now, steps = going[~done], now[~done], steps + 1
            symbol, place = self.tree.follow(now)
            now = self.base[symbol] + place
        return found

    def first_places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest text position among the rows low to high of each search."""
        if not len(low):
            return low
        sizes = high - low
        begins = np.cumsum(sizes) - sizes
        rows = np.arange(sizes.sum()) + np.repeat(low - begins, sizes)
        distinct, which = np.unique(rows, return_inverse=True)
        return np.minimum.reduceat(self.places(distinct)[which], begins)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling the length that ranks tell."""
    rank, reach = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while reach < 2 * len(text):
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-reach] = rank[reach:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(rank), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))[: len(order)]
        if rank[order[-1]] == len(order) - 1:
            break
        reach *= 2
    return order
