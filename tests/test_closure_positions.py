import pytest
from pyspark.sql import functions as F

from conftest import rows
from tesoro.operators import quality, review, staging


def test_one_call_deletes_all_that_hangs_on_an_entity(spark):
    tables = {
        "core_transaction": spark.createDataFrame(
            [(1, 10, 100), (2, 11, 100), (3, 12, 103), (4, 12, None), (5, None, 101)], "id long, account_id long, category_id long"),
        "core_account": spark.createDataFrame([(10, 1), (11, 2), (12, 2)], "id long, entity_id long"),
        "core_entity": spark.createDataFrame([(1,), (2,)], "id long"),
        "core_category": spark.createDataFrame([(100, None), (101, 100), (102, 101), (103, None)], "id long, parent_id long"),
        "core_cashflowevent": spark.createDataFrame([(7, 1), (8, 2)], "id long, entity_id long")}
    keys = [k for k in quality.FOREIGN_KEYS if k[0] in tables]
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    after, gone = quality.delete_closure(tables, {"core_entity": one(1), "core_category": one(100)}, keys)
    assert rows(after["core_transaction"]) == sorted([(2, 11, None), (3, 12, 103), (4, 12, None), (5, None, 101)], key=repr)
    assert rows(after["core_account"]) == [(11, 2), (12, 2)] and rows(after["core_cashflowevent"]) == [(8, 2)]
    assert rows(after["core_category"]) == sorted([(101, None), (102, 101), (103, None)], key=repr)
    assert rows(gone["core_transaction"]) == [(1,)]
    # a category that takes its subcategories with it, also in a cycle
    tree = tables["core_category"].union(spark.createDataFrame([(200, 201), (201, 200)], "id long, parent_id long"))
    cascade = [k for k in keys if k[1] != "parent_id"] + [("core_category", "parent_id", "core_category", "cascade")]
    after, gone = quality.delete_closure({**tables, "core_category": tree}, {"core_category": one(100).union(one(200))}, cascade)
    assert rows(after["core_category"]) == [(103, None)]
    assert rows(after["core_transaction"], "id", "category_id") == sorted([(1, None), (2, None), (3, 103), (4, None), (5, None)], key=repr)
    # nothing deleted, unknown ids, and keys that form a cycle
    same, gone = quality.delete_closure(tables, {"core_entity": one(99)}, keys)
    assert rows(same["core_transaction"]) == rows(tables["core_transaction"]) and gone["core_entity"].count() == 0
    with pytest.raises(ValueError):
        quality.delete_closure(tables, {}, [*keys, ("core_entity", "id", "core_account", "cascade")])


def test_positions_number_the_whole_order(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 AS k", "id % 3 AS x").repartition(7)
    order = (F.col("x").desc(), F.col("k").asc())
    got = [tuple(r) for r in review.with_position(df, *order).collect()]
    want = sorted(((r["k"], r["x"]) for r in df.collect()), key=lambda r: (-r[1], r[0]))
    assert got == [(*r, i) for i, r in enumerate(want, 1)]
    assert review.with_position(df.limit(0), *order).collect() == []


def test_the_sketch_admits_every_hot_key(spark, monkeypatch):
    """Hot, nearly hot and many rare keys; the account path finds the same."""
    df = spark.range(60_000).selectExpr(
        "id AS transaction_id", "cast(NULL AS timestamp) AS created_at", "date'2024-01-01' AS transaction_date",
        "cast(1 AS decimal(14,2)) AS amount",
        "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN id % 8 ELSE id END AS account_id")
    want = [(1, 7500), (5, 7500), (None, 15000)]
    for limit, keep in ((1000, want), (7499, want), (7500, want[2:]), (20_000, [])):
        found, _ = staging._find_hot_groups(df, limit)
        assert sorted(((r["_h_account_id"], r["_n"]) for r in found), key=repr) == sorted(keep, key=repr)
    monkeypatch.setattr(staging, "MAX_TRACKED", 10)
    found, _ = staging._find_hot_groups(df, 7499)
    assert sorted(((r["_h_account_id"], r["_n"]) for r in found), key=repr) == sorted(want, key=repr)
    assert staging._find_hot_groups(df.limit(10), 10) == ([], None)  # no more rows than a group may have


def test_positions_of_many_rows_are_given_in_as_many_slices(spark, monkeypatch):
    from tesoro.functions import storage
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 10)
    df = spark.range(200).selectExpr("(id * 37) % 200 AS k", "id % 3 AS g")
    out = review.with_position(df, F.col("g").desc(), F.col("k"), rows=200)
    got = [(r["g"], r["k"], r["position"]) for r in out.collect()]
    want = sorted(((i % 3, (i * 37) % 200) for i in range(200)), key=lambda r: (-r[0], r[1]))
    assert got == [(*r, i + 1) for i, r in enumerate(want)]
    assert out.rdd.getNumPartitions() == 20
