import random

import numpy as np
import pytest

from tesoro.llm.match_index import Bits, MatchIndex, WaveletTree, suffix_order


@pytest.mark.parametrize("n,top", [(1, 1), (50, 2), (400, 3), (3000, 70000), (2000, 1)])
def test_suffix_order(n, top):
    rng = np.random.default_rng(n)
    text = np.r_[rng.integers(1, top + 1, n), 0]
    assert suffix_order(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())


def test_rank_of_bits_and_symbols():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, 1000).astype(np.uint8)
    places = np.arange(1001)
    assert Bits(bits).rank(places).tolist() == np.r_[0, np.cumsum(bits)].tolist()
    for sequence in (np.minimum(rng.geometric(.2, 3000), 40), np.full(70, 3), rng.integers(0, 100000, 500)):
        tree = WaveletTree(sequence)
        symbols, at = rng.choice(sequence, 300), rng.integers(0, len(sequence) + 1, 300)
        assert tree.rank(symbols, at).tolist() == [int((sequence[:p] == s).sum()) for s, p in zip(symbols, at)]


@pytest.mark.parametrize("seed,top,width", [(1, 2, 5), (2, 6, 3), (3, 30, 4)])
def test_matching_statistics(seed, top, width):
    rng = random.Random(seed)
    text = [rng.randint(1, top) for _ in range(400)]
    owner = np.array([i // 7 for i in range(400)])
    index = MatchIndex(np.array(text), width, owner)
    query = [rng.randint(0, top + 2) for _ in range(60)] + text[100:140] + [rng.randint(1, top) for _ in range(30)]
    cuts = sorted(rng.sample(range(len(query)), 6))
    starts, ends = np.array([0, *cuts]), np.array([*cuts, len(query)])
    seen = set()
    for places, lengths, low, high in index.statistics(np.array(query), starts, ends):
        for p, n, a, b in zip(places.tolist(), lengths.tolist(), low, high):
            end = min(e for e in ends.tolist() if e > p)
            occurs = [[i for i in range(401 - k) if text[i:i + k] == query[p:p + k]] for k in range(min(width, end - p) + 1)]
            want = max(k for k, found in enumerate(occurs) if found)
            assert n == want
            if n:
                assert b - a == len(occurs[n])
                assert index.least_owner(np.array([a]), np.array([b]))[0] == min(owner[i] for i in occurs[n])
            seen.add(p)
    assert seen == set(range(len(query)))
