"""Compressed FM-index for matching statistics: a wavelet tree shaped by the symbols'
frequencies (Shannon code lengths, bit planes packed into words with counts a word) over
the Burrows-Wheeler transform, and the common prefixes of neighbouring suffixes, cut at
the threshold. All queries work on many lanes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` (non-negative integers, the last one
    smaller than all others) in lexicographic order: sorted by as many symbols as fit
    into a word, then by prefix doubling of what still ties."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    length = max(1, 62 // bits)
    keys, padded = np.zeros(n, dtype=np.int64), np.r_[text, np.zeros(length, dtype=np.int64)]
    for j in range(length):
        keys = keys << bits | padded[j:j + n]
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(new, np.diff(np.r_[new, n]))

    def tied(sorted_: np.ndarray) -> np.ndarray:
        same = sorted_[1:] == sorted_[:-1]
        return np.r_[False, same] | np.r_[same, False]

    slots = np.flatnonzero(tied(keys))
    while len(slots):
        group = order[slots]
        follow = group + length
        combined = rank[group] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.argsort(combined)  # slots of one rank are adjacent: sorting stays within them
        group, combined = group[by], combined[by]
        order[slots] = group
        new = np.flatnonzero(np.r_[True, combined[1:] != combined[:-1]])
        rank[group] = np.repeat(slots[new], np.diff(np.r_[new, len(slots)]))
        slots = slots[tied(combined)]
        length *= 2
    return order


class Bits:
    """A packed sequence of bits with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        data = np.packbits(bits, bitorder="little")
        self.words = np.r_[data, np.zeros(8 + -len(data) % 8, np.uint8)].view("<u8")
        ones = np.bitwise_count(self.words)
        self.before = np.r_[0, np.cumsum(ones[:-1], dtype=np.int64)].astype(np.uint32)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = places >> 6
        mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Rank of symbols in a sequence of integers. A symbol that makes up ``1 / 2**k`` of
    the sequence takes about ``k`` planes."""

    def __init__(self, sequence: np.ndarray):
        counts = np.maximum(np.bincount(sequence), 1)
        lengths = np.maximum(np.frexp((-(-counts.sum() // counts) - 1).astype(float))[1], 1).astype(np.int64)
        order = np.argsort(lengths, kind="stable")
        self.code_of = np.empty(len(counts), dtype=np.int64)  # by symbol: its number in code order
        self.code_of[order] = np.arange(len(counts))
        lengths, counts = lengths[order], np.bincount(sequence, minlength=len(counts))[order]
        top = int(lengths[-1])
        codes = np.cumsum(np.r_[0, 1 << (top - lengths[:-1])])  # left-aligned canonical codes
        current, self.levels = self.code_of[sequence], []
        for level in range(top):
            first = int(np.searchsorted(lengths, level, side="right"))  # the shorter codes have ended
            current = current[current >= first]
            step = codes >> (top - 1 - level)
            plane = Bits((step[current] & 1).astype(np.uint8))
            node = step[first:] >> 1
            starts = np.r_[0, np.cumsum(counts[first:])][np.searchsorted(node, node)]
            self.levels.append((first, plane, starts, plane.rank(starts), (step[first:] & 1).astype(bool)))
            key = step[current] - (step[first] if first < len(step) else 0)
            current = current[np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")]

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its place."""
        code, out = self.code_of[symbols], places.copy()
        live = np.arange(len(code))
        for first, plane, starts, ones, bit in self.levels:
            live = live[code[live] >= first]
            if not len(live):
                break
            own, at = code[live] - first, out[live]
            rank = plane.rank(starts[own] + at) - ones[own]
            out[live] = np.where(bit[own], rank, at - rank)
        return out


class MatchIndex:
    """Index of ``text``, integers of 1 or more, for matches of up to ``width`` symbols.
    ``owner`` has a number for each position, such as the document it is in."""

    def __init__(self, text: np.ndarray, width: int, owner: np.ndarray):
        text = np.r_[text.astype(np.int64), 0]
        order = suffix_order(text)
        self.size, self.width = len(text), width
        self.first = np.r_[0, np.cumsum(np.bincount(text))]
        self.waves = WaveletTree(text[order - 1])
        self.owner = np.r_[owner, np.iinfo(owner.dtype).max][order]
        self.shared = np.zeros(self.size, dtype=np.uint8)  # symbols shared with the suffix before
        live = np.arange(1, self.size)
        for j in range(width):
            live = live[text[order[live - 1] + j] == text[order[live] + j]]
            self.shared[live] = j + 1
        self._heads: dict[int, np.ndarray] = {}

    def _widened(self, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that share ``length`` symbols with each row."""
        if length not in self._heads:
            self._heads[length] = np.r_[np.flatnonzero(self.shared < length), self.size]
        heads = self._heads[length]
        at = np.searchsorted(heads, rows, side="right")
        return heads[at - 1], heads[at]

    def _extended(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the ranges with a symbol put before them."""
        rank = self.waves.rank(np.r_[symbols, symbols], np.r_[low, high])
        base = self.first[symbols]
        return base + rank[:len(symbols)], base + rank[len(symbols):]

    def statistics(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray
                   ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of the sequences ``text[starts:ends]``, from their ends to
        their starts. Each round gives ``(places, lengths, low, high)``: for a place of each
        sequence that is long enough, how many symbols from it on occur in the index (at
        most ``width``), and the suffix range of these occurrences."""
        lanes = np.argsort(starts - ends, kind="stable")  # the longest first
        sizes = (ends - starts)[lanes]
        n = len(lanes)
        low, high, length = np.zeros(n, np.int64), np.full(n, self.size), np.zeros(n, np.int64)
        for back in range(1, int(sizes[0]) + 1 if n else 1):
            n = int(np.searchsorted(-sizes, -back, side="right"))
            places = ends[lanes[:n]] - back
            symbols = text[places]
            known = (symbols > 0) & (symbols < len(self.first) - 1)
            low, high, length = low[:n], high[:n], length[:n]
            low[~known], high[~known], length[~known] = 0, self.size, 0
            open_ = np.flatnonzero(known)
            while len(open_):  # shorten the match until the symbol can go before it
                a, b = self._extended(symbols[open_], low[open_], high[open_])
                hit = a < b
                done = open_[hit]
                low[done], high[done] = a[hit], b[hit]
                length[done] += 1
                open_ = open_[~hit & (length[open_] > 0)]
                length[open_] -= 1
                for size in np.unique(length[open_]).tolist():
                    some = open_[length[open_] == size]
                    low[some], high[some] = self._widened(low[some], size) if size else (0, self.size)
            over = np.flatnonzero(length > self.width)
            low[over], high[over] = self._widened(low[over], self.width)
            length[over] = self.width
            yield places, length.copy(), low.copy(), high.copy()

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest owner of the suffixes of each range. Ranges are equal or apart, as
        those of matches of one length are."""
        unique, first, which = np.unique(low, return_index=True, return_inverse=True)
        sizes = high[first] - unique
        ends = np.cumsum(sizes)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(unique - ends + sizes, sizes)
        return np.minimum.reduceat(self.owner[rows], ends - sizes)[which] if len(rows) else np.zeros(0, self.owner.dtype)
