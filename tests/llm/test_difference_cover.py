import random

import pytest

from tesoro.llm.common import prepare
from tesoro.llm.difference_cover import suffix_order, suffix_ranks, triples_of


@pytest.mark.parametrize("seed,symbols", [(1, 2), (2, 3), (3, 1)])
def test_ranks_follow_the_suffix_order_through_the_recursion(spark, seed, symbols):
    prepare(spark)
    rng = random.Random(seed)
    strings = [[rng.randint(1, symbols) for _ in range(rng.randint(1, 40))] for _ in range(12)]
    strings += [strings[0], strings[1] + strings[2]]
    rows = [(s * 3, i, x) for s, text in enumerate(strings) for i, x in enumerate(text)]
    frame = spark.createDataFrame(rows, "sid long, pos int, sym long")
    ranked = sorted((r["rank"], strings[r["sid"] // 3][r["pos"]:]) for r in suffix_ranks(frame, base=30).collect())
    assert len(ranked) == len(rows) and len({r for r, _ in ranked}) == len(rows)
    assert [s for _, s in ranked] == sorted(s for _, s in ranked)


@pytest.mark.parametrize("prefix", [None, 2, 7])
def test_order_up_to_a_prefix(spark, prefix):
    prepare(spark)
    rng = random.Random(9)
    part = [rng.randint(1, 3) for _ in range(25)]
    strings = [part[rng.randint(0, 5):] + [rng.randint(1, 3) for _ in range(rng.randint(0, 9))] for _ in range(15)]
    rows = [(s, i, x) for s, text in enumerate(strings) for i, x in enumerate(text)]
    frame = spark.createDataFrame(rows, "sid long, pos int, sym long")
    ordered = suffix_order(triples_of(frame), len(rows), prefix, base=10).collect()
    got = [strings[r["sid"]][r["pos"]:][:prefix] for r in ordered]
    assert len(got) == len(rows) and got == sorted(got)


def test_empty(spark):
    assert suffix_ranks(spark.createDataFrame([], "sid long, pos int, sym long")).count() == 0
