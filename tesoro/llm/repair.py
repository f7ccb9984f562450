"""Re-Pair grammar compression of token ids, and the binary shard format.

A shard holds whole documents. Frequent pairs of neighbouring symbols are replaced by
nonterminals, again and again, until no pair is left whose rule pays. The rules and the
length of every nonterminal's expansion are stored, so any document can be decoded
alone.

File layout, little-endian: magic ``RPR2``; uint32 number of documents D, rules R,
first nonterminal N, symbol width W in bits (16 to 32); uint64 number of symbols S; then
uint32 left[R], right[R], expansion length[R]; int64 id[D]; uint8 id known[D]; uint64
first symbol[D + 1]; uint64 first token[D + 1]; uint16 low bits of symbol[S]; for each
further bit, lowest first, that bit of all symbols, 8 to a byte, the first the highest.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"RPR2"
_HEADER = struct.Struct("<4sIIIIQ")

# A rule costs RULE_BYTES; a pair becomes one if its places save more than that.
RULE_BYTES = 12
# Rules made before the pairs around them are counted again, and the least frequency of
# their pairs as a share of the most frequent one's.
RULES_PER_ROUND = 512
NEARLY = 0.8
# The bits of a symbol that are stored as one integer; further ones are bit planes.
LOW_BITS = 16


def symbol_bits(symbols: int) -> int:
    """Bits of a symbol in a file of so many different ones."""
    return max(LOW_BITS, (symbols - 1).bit_length())


def paying_places(symbols: int) -> int:
    """The fewest places at which a pair's rule saves bytes."""
    return RULE_BYTES * 8 // symbol_bits(symbols) + 1


def _grouped(left: np.ndarray, right: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ordered by their pair and then by themselves, and where each pair's begin."""
    if not len(places):
        return places, np.zeros(0, dtype=np.int64)
    bits = int(max(left.max(), right.max())).bit_length()
    place_bits = int(places.max()).bit_length()
    pairs = (left.astype(np.uint64) << np.uint64(bits)) | right
    if 2 * bits + place_bits <= 64:  # pair and place in one integer
        both = np.sort((pairs << np.uint64(place_bits)) | places.astype(np.uint64))
        places = (both & np.uint64((1 << place_bits) - 1)).astype(places.dtype)
        pairs = both >> np.uint64(place_bits)
    else:
        order = np.lexsort((places, pairs))
        pairs, places = pairs[order], places[order]
    return places, np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])


class _Text:
    """The symbols of all documents as lists with links, and the pairs that have
    ``min_pairs`` places, with their places. Place n stands for none, pair 0 for one that
    is not frequent.

    A pair gets places only when the younger of its symbols is made, so the places found
    then are all it ever has; later ones can only go.
    """

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, min_pairs: int):
        n = self.none = len(symbols)
        self.min_pairs = min_pairs
        self.symbols = np.r_[symbols, np.uint32(0)]
        self.next = np.arange(1, n + 2)
        self.before = np.arange(-1, n)
        edges = starts[(starts > 0) & (starts < n)]
        self.next[edges - 1] = n
        self.before[edges] = n
        self.before[0] = n
        self.alive = np.ones(n, dtype=bool)
        self.pair = np.zeros(n + 1, dtype=np.int32)
        # a replacement makes two places at most
        self.where = np.empty(3 * n, dtype=np.int64)
        self.used, self.pairs = 0, 1
        self.first, self.size, self.counts = (np.zeros(3 * n // min_pairs + 2, dtype=np.int32) for _ in range(3))
        self.left, self.right = (np.zeros(len(self.first), dtype=np.uint32) for _ in range(2))
        self._count(np.flatnonzero(self.next[:n] != n))

    def _count(self, places: np.ndarray) -> None:
        """Find the frequent pairs at places that have a new pair."""
        places, first = _grouped(self.symbols[places], self.symbols[self.next[places]], places)
        sizes = np.diff(np.r_[first, len(places)])
        frequent = sizes >= self.min_pairs
        places, sizes = places[np.repeat(frequent, sizes)], sizes[frequent]
        begin, end = self.pairs, self.pairs + len(sizes)
        one = places[np.cumsum(sizes) - sizes]
        self.left[begin:end], self.right[begin:end] = self.symbols[one], self.symbols[self.next[one]]
        self.where[self.used:self.used + len(places)] = places
        self.first[begin:end] = self.used + np.cumsum(sizes) - sizes
        self.size[begin:end] = self.counts[begin:end] = sizes
        self.pair[places] = np.repeat(np.arange(begin, end, dtype=np.int32), sizes)
        self.used, self.pairs = self.used + len(places), end

    def choose(self, at_most: int) -> np.ndarray:
        """Pairs of nearly the highest count, the most frequent first, that can't overlap
        each other; of none if no pair is frequent."""
        counts = self.counts[:self.pairs]
        top = int(counts.max())
        if top < self.min_pairs:
            return np.zeros(0, dtype=np.int64)
        found = np.flatnonzero(counts >= max(self.min_pairs, NEARLY * top))
        found = found[np.argsort(-counts[found], kind="stable")]
        chosen: list[int] = []
        lefts, rights = set(), set()
        for pair, a, b in zip(found.tolist(), self.left[found].tolist(), self.right[found].tolist()):
            if a not in rights and b not in lefts:
                chosen.append(pair)
                lefts.add(a)
                rights.add(b)
                if len(chosen) == at_most:
                    break
        return np.array(chosen, dtype=np.int64)

    def replace(self, chosen: np.ndarray, first_rule: int) -> np.ndarray:
        """Make rules of the chosen pairs, replace their places, left to right in a run of
        overlapping ones, and count the pairs around. Returns the pairs that became
        rules: not those of two equal symbols that overlap too often."""
        size = self.size[chosen].astype(np.int64)
        ends = np.cumsum(size)
        at = self.where[np.arange(ends[-1]) + np.repeat(self.first[chosen] - (ends - size), size)]
        rank = np.repeat(np.arange(len(chosen)), size)
        there = self.pair[at] == chosen[rank]
        at, rank = at[there], rank[there]
        # only places of one pair can overlap: keep every second of a run
        place = np.arange(len(at))
        head = np.ones(len(at), dtype=bool)
        head[1:] = self.next[at[:-1]] != at[1:]
        keep = (place - np.maximum.accumulate(np.where(head, place, 0))) & 1 == 0
        at, rank = at[keep], rank[keep]
        found = np.bincount(rank, minlength=len(chosen))
        pays = found >= self.min_pairs
        self.counts[chosen] = np.where(pays, 0, found)
        at, rank = at[pays[rank]], (np.cumsum(pays) - 1)[rank[pays[rank]]]
        if not len(at):
            return chosen[:0]

        gone, none = self.next[at], self.none
        self.pair[at] = 0
        for near in (gone, self.before[at]):  # one after the other: a place can be both
            pairs = self.pair[near]
            self.counts[:self.pairs] -= np.bincount(pairs[pairs > 0], minlength=self.pairs).astype(np.int32)
            self.pair[near] = 0
        after = self.next[gone]
        self.symbols[at] = first_rule + rank
        self.alive[gone] = False
        self.next[at] = after
        self.before[after] = at
        left = self.before[at]
        left = left[(left != none) & (self.symbols[left] < first_rule)]  # the others are in at
        self._count(np.r_[at[after != none], left])
        return chosen[pays]

    def packed(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left, and the documents' starts among them."""
        before = np.r_[0, np.cumsum(self.alive)]
        return self.symbols[:-1][self.alive], before[starts]


@dataclass
class Shard:
    """Documents of ``symbols`` over a grammar; nonterminal ``first_rule + i`` stands
    for ``left[i], right[i]`` and expands to ``lengths[i]`` token ids."""
    ids: list[int | None]
    starts: np.ndarray        # first symbol of each document, and the end
    token_starts: np.ndarray  # first token of each document, and the end
    symbols: np.ndarray
    first_rule: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray

    def to_bytes(self) -> bytes:
        width = symbol_bits(self.first_rule + len(self.left))
        parts = [np.asarray(x, dtype=kind).tobytes() for x, kind in (
            (self.left, "<u4"), (self.right, "<u4"), (self.lengths, "<u4"),
            ([0 if i is None else i for i in self.ids], "<i8"), ([i is not None for i in self.ids], "u1"),
            (self.starts, "<u8"), (self.token_starts, "<u8"), (self.symbols & 0xFFFF, "<u2"))]
        parts += [np.packbits((self.symbols >> bit & 1).astype(bool)).tobytes() for bit in range(LOW_BITS, width)]
        head = _HEADER.pack(MAGIC, len(self.ids), len(self.left), self.first_rule, width, len(self.symbols))
        return b"".join([head, *parts])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, docs, rules, first_rule, width, n = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair shard")
        at = _HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out
        left, right, lengths = (take("<u4", rules).astype(np.int64) for _ in range(3))
        ids, known = take("<i8", docs).tolist(), take("u1", docs).tolist()
        starts, token_starts = take("<u8", docs + 1).astype(np.int64), take("<u8", docs + 1).astype(np.int64)
        symbols = take("<u2", n)
        if width > LOW_BITS:
            symbols = symbols.astype(np.uint32)
        for bit in range(LOW_BITS, width):
            symbols |= np.unpackbits(take("u1", -(-n // 8)), count=n).astype(np.uint32) << np.uint32(bit)
        return cls([i if k else None for i, k in zip(ids, known)], starts, token_starts, symbols, first_rule, left, right,
                   lengths)

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every symbol where its expansion starts and its length, and the
        expansions: the terminals themselves, then the rules'."""
        if not hasattr(self, "_table"):
            ends = self.first_rule + np.cumsum(self.lengths)
            starts = np.r_[np.arange(self.first_rule), ends - self.lengths]
            lengths = np.r_[np.ones(self.first_rule, dtype=np.int64), self.lengths]
            flat = np.empty(ends[-1] if len(ends) else self.first_rule, dtype=np.uint32)
            flat[:self.first_rule] = np.arange(self.first_rule)
            done = np.zeros(len(lengths), dtype=bool)
            done[:self.first_rule] = True
            rules = np.arange(len(self.left))
            while len(rules):  # those whose sides are expanded; rules refer to earlier rules only
                ready = done[self.left[rules]] & done[self.right[rules]]
                now, rules = rules[ready], rules[~ready]
                left, right, to = self.left[now], self.right[now], starts[self.first_rule + now]
                for side, at in ((left, to), (right, to + lengths[left])):
                    size = lengths[side]
                    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    flat[place + np.repeat(at, size)] = flat[place + np.repeat(starts[side], size)]
                done[self.first_rule + now] = True
            self._table = starts, lengths, flat
        return self._table

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Token ids of documents ``first`` to ``last`` - 1 (all by default)."""
        last = len(self.ids) if last is None else last
        symbols = self.symbols[self.starts[first]:self.starts[last]]
        starts, lengths, flat = self._tables()
        size = lengths[symbols]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0)
        place += np.repeat(starts[symbols] - (ends - size), size)
        return flat[place]


def compress(ids: list[int | None], tokens: np.ndarray, token_starts: np.ndarray, first_rule: int,
             min_pairs: int | None = None, per_round: int = RULES_PER_ROUND) -> Shard:
    """Re-Pair over the documents ``tokens[token_starts[d]:token_starts[d + 1]]``; all
    ids are below ``first_rule``. Pairs never cross documents. Every round makes rules of
    the most frequent pairs, at most ``per_round``, and counts the pairs around their
    places again; when no pair is left that has ``min_pairs`` places (by default: so many
    that its rule pays), all pairs are counted anew, until that finds none either."""
    symbols = np.asarray(tokens, dtype=np.uint32)
    starts = np.asarray(token_starts, dtype=np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    made = 0
    while True:
        text = _Text(symbols, starts, min_pairs or paying_places(first_rule + made))
        before = made
        while len(chosen := text.choose(per_round)):
            chosen = text.replace(chosen, first_rule + made)
            left.append(text.left[chosen].astype(np.int64))
            right.append(text.right[chosen].astype(np.int64))
            made += len(chosen)
        if made == before:
            break
        symbols, starts = text.packed(starts)
    size = np.ones(first_rule + made, dtype=np.int64)
    at = first_rule
    for a, b in zip(left, right):  # the sides of a round's rules are older
        size[at:at + len(a)] = size[a] + size[b]
        at += len(a)
    if first_rule + made <= 1 << LOW_BITS:
        symbols = symbols.astype(np.uint16)
    return Shard(ids, starts, np.asarray(token_starts, dtype=np.int64), symbols, first_rule, np.concatenate(left),
                 np.concatenate(right), size[first_rule:])
