"""FM-index over a sequence of small integers: suffix array by prefix doubling, a
wavelet matrix over the Burrows-Wheeler transform, backward search for many phrases
at a time, and location of occurrences by sampled suffix positions.
"""

from __future__ import annotations

import numpy as np

# Every SAMPLE-th text position keeps its place in the suffix order.
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ``text`` (non-negative integers) in
    lexicographic order; a proper prefix sorts first. Only suffixes that still tie
    are sorted again when the compared length doubles."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, dtype=np.int64)

    def tied(keys: np.ndarray) -> np.ndarray:
        """True where an entry of the sorted keys equals a neighbour."""
        same = keys[1:] == keys[:-1]
        out = np.zeros(len(keys), dtype=bool)
        out[1:] |= same
        out[:-1] |= same
        return out

    keys = text[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    slots = np.flatnonzero(tied(keys))
    length = 1
    while len(slots):
        group = order[slots]
        follow = np.full(len(group), -1, dtype=np.int64)
        inside = group + length < n
        follow[inside] = rank[group[inside] + length]
        # slots of one rank are adjacent, so sorting by (rank, follow) stays within them
        by = np.lexsort((follow, rank[group]))
        group, follow, head = group[by], follow[by], rank[group][by]
        order[slots] = group
        new = np.r_[True, (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])]
        first = np.flatnonzero(new)
        rank[group] = np.repeat(slots[first], np.diff(np.r_[first, len(slots)]))
        slots = slots[tied(rank[group])]
        length *= 2
    return order


class WaveletMatrix:
    """Bit planes of a sequence, most significant first; each plane is followed by a
    stable partition into zeros and ones, so rank and access take one step a plane."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.planes = []
        current = sequence.astype(np.int64)
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (current >> bit) & 1
            before = np.zeros(len(current) + 1, dtype=np.int64)  # ones before each place
            np.cumsum(ones, out=before[1:])
            self.planes.append((bit, before, len(current) - int(before[-1])))
            current = np.r_[current[ones == 0], current[ones == 1]]

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its place."""
        low, high = np.zeros_like(places), places
        for bit, before, zeros in self.planes:
            one = (symbols >> bit) & 1 == 1
            low = np.where(one, zeros + before[low], low - before[low])
            high = np.where(one, zeros + before[high], high - before[high])
        return high - low

    def access(self, places: np.ndarray) -> np.ndarray:
        """The symbols at the places."""
        out, at = np.zeros_like(places), places
        for bit, before, zeros in self.planes:
            one = before[at + 1] - before[at]
            out |= one << bit
            at = np.where(one == 1, zeros + before[at], at - before[at])
        return out


class FMIndex:
    """Index of ``text``, integers of 1 or more; 0 is kept for the end."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.r_[text.astype(np.int64), 0]
        order = suffix_array(text)
        self.size = len(text)
        top = int(text.max())
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))]
        self.waves = WaveletMatrix(text[order - 1], top)  # the symbol before each suffix
        marked = order % sample == 0
        self.marks = np.r_[0, np.cumsum(marked)]
        self.samples = order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [low, high) of each row of ``phrases`` (right-aligned, row i
        has ``lengths[i]`` symbols): backward search, all rows a symbol at a time."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        width = phrases.shape[1]
        live = np.arange(len(phrases))
        for back in range(1, width + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            symbols = phrases[live, width - back]
            known = symbols < len(self.first) - 1
            high[live[~known]] = low[live[~known]] = 0
            live, symbols = live[known], symbols[known]
            base = self.first[symbols]
            low[live] = base + self.waves.rank(symbols, low[live])
            high[live] = base + self.waves.rank(symbols, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a sampled position."""
        at, walked = rows.copy(), np.zeros_like(rows)
        open_ = np.flatnonzero(self.marks[at + 1] == self.marks[at])
        while len(open_):
            symbols = self.waves.access(at[open_])
            at[open_] = self.first[symbols] + self.waves.rank(symbols, at[open_])
            walked[open_] += 1
            open_ = open_[self.marks[at[open_] + 1] == self.marks[at[open_]]]
        return self.samples[self.marks[at]] + walked
