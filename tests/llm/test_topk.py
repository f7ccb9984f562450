import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesoro.llm import topk as K
from tesoro.llm.common import prepare


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def slow(rows, queries, k):
    """(query, rank, id, score) by Python integers over all pairs."""
    whole = [(i, [int(np.floor(K.SCALE * x)) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for n, (i, v) in enumerate(whole):
        if i in queries:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(whole)
                           if m != n and len(v) == len(w))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def vectors(seed):
    rng = random.Random(seed)
    draw = lambda n: [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(n)]
    common = draw(4)
    rows = [(i, common if i % 3 == 0 else draw(4)) for i in range(120)]
    rows += [(200, None), (201, [0.1, None, 0.2, 0.3]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]),
             (None, draw(4)), (204, []), (205, []), (206, draw(3)), (207, draw(3)), (208, [1e9, -1e9, 3e8, 5.0]), (209, [0.0] * 4)]
    return rows


@pytest.mark.parametrize("k,block", [(5, 4096), (3, 7), (500, 4096)])
def test_matches_all_pairs(spark, monkeypatch, k, block):
    prepare(spark)
    monkeypatch.setattr(K, "BLOCK_QUERIES", block)
    rows = vectors(k)
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(5)
    wanted = {0, 3, 50, 100, 200, 201, 204, 206, 208, 209}
    found = K.top_k(table.where(F.col("vec_id").isin(*wanted)), table, k)
    assert sorted(map(tuple, found.collect())) == slow(rows, wanted, k)


def test_rows_that_share_the_query_id_are_candidates(spark):
    prepare(spark)
    rows = [(50, [1.0, 0.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (3, [0.25, 1.0]), (50, [-1.0, 0.0]), (50, [1.0, -0.25]),
            (7, [0.0, 0.0]), (100, [-0.5, -0.5]), (100, [-0.5, -0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for k in (1, 2, 5, 20):
        found = K.top_k(table.where(F.col("vec_id").isin(50, 100)), table, k)
        assert sorted(map(tuple, found.collect())) == slow(rows, {50, 100}, k)


def test_empty_sides_and_a_single_row(spark):
    prepare(spark)
    table = spark.createDataFrame([(1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert K.top_k(table, table).count() == 0          # no candidate but itself
    assert K.top_k(table.limit(0), table).count() == 0
    assert K.top_k(table, table.limit(0)).count() == 0


def test_scores_beyond_a_double_are_exact():
    q, c = np.array([[2.0 ** 40, 3.0, -1.0]]), np.array([[2.0 ** 20, 1.0, 5.0], [2.0 ** 45, 0.0, 1.0]])
    assert K.scores(q, c).tolist() == [[2 ** 60 + 3 - 5, 2 ** 63 - 1]]


def test_query_matches_all_pairs_on_the_whole_table(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    ids, whole = np.array([r[0] for r in rows]), np.floor(np.array([r[1] for r in rows], dtype=np.float64) * 256).astype(int)
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = whole @ whole[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:5]
        want += [(int(ids[q]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    assert sorted(map(tuple, K.op6_exact_topk(spark, sf).collect())) == sorted(want)
