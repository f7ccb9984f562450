import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesoro.llm.fm_index import FMIndex, WaveletMatrix, suffix_array

texts = st.lists(st.integers(1, 4), min_size=0, max_size=60)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_suffix_array_is_the_sorted_order(text):
    got = suffix_array(np.array(text, dtype=np.int64)).tolist()
    assert got == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(texts.filter(len))
def test_wavelet_rank_and_access(text):
    waves = WaveletMatrix(np.array(text), max(text))
    places = np.arange(len(text))
    assert waves.access(places).tolist() == text
    for symbol in range(1, max(text) + 1):
        ranks = waves.rank(np.full(len(text) + 1, symbol), np.arange(len(text) + 1))
        assert ranks.tolist() == [text[:i].count(symbol) for i in range(len(text) + 1)]


@settings(max_examples=200, deadline=None)
@given(texts, st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=4), min_size=1, max_size=6))
def test_search_and_locate_find_every_occurrence(text, phrases):
    index = FMIndex(np.array(text, dtype=np.int64))
    table = np.array([[0] * (4 - len(p)) + p for p in phrases])
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        places = sorted(index.locate(np.arange(a, b)).tolist()) if b > a else []
        assert places == [i for i in range(len(text) - len(p) + 1) if text[i:i + len(p)] == p]
