import datetime as dt
from decimal import Decimal as D

import pytest

from pyspark.sql import functions as F

from conftest import rows
from tesoro.functions import storage
from tesoro.operators import marts, review, staging

TXN_SCHEMA = ("transaction_id string, account_id bigint, category_id bigint, transaction_date date, "
              "amount decimal(14,2), description string, source_doc_ref string, "
              "is_duplicate_flag boolean, confidence_score double, created_at timestamp")


def txn(tid, acct, cat, day, amount, created):
    return (tid, acct, cat, dt.date.fromisoformat(day), None if amount is None else D(amount),
            "d", tid, False, None,
            dt.datetime.fromisoformat(created))


def dup_fixture(spark):
    data = [
        # three copies: same account, amount, date; tie on created_at broken by id
        txn("t1", 1, 10, "2024-01-05", "50.00", "2024-01-06 10:00:00"),
        txn("t0", 1, 20, "2024-01-05", "50.00", "2024-01-06 10:00:00"),
        txn("t2", 1, 10, "2024-01-05", "50.00", "2024-01-06 09:00:00"),
        # a single row
        txn("t3", 1, 10, "2024-01-07", "70.00", "2024-01-07 10:00:00"),
        # a pair whose secondary sits in another category than its primary (trap 10)
        txn("t4", 2, 10, "2024-02-01", "30.00", "2024-02-01 01:00:00"),
        txn("t5", 2, 30, "2024-02-01", "30.00", "2024-02-01 02:00:00"),
        # NULL amount group
        txn("t6", 3, 10, "2024-02-01", None, "2024-02-01 01:00:00"),
        txn("t7", 3, 10, "2024-02-01", None, "2024-02-01 01:00:00"),
    ]
    return spark.createDataFrame(data, TXN_SCHEMA)


def test_duplicate_flags_and_tie_break(spark):
    d = staging.flag_duplicates(dup_fixture(spark))
    got = {r[0]: tuple(r[1:]) for r in d.select(
        "transaction_id", "dup_group_size", "dup_rank", "is_likely_duplicate",
        "is_duplicate_secondary").collect()}
    assert got["t2"] == (3, 1, True, False)       # earliest created_at
    assert got["t0"] == (3, 2, True, True)        # tie on created_at: lower id first
    assert got["t1"] == (3, 3, True, True)
    assert got["t3"] == (1, 1, False, False)
    assert got["t4"][1] == 1 and got["t5"][1] == 2
    assert sorted([got["t6"][1], got["t7"][1]]) == [1, 2]   # NULL keys group together


def test_hot_group_split_path_equals_window_path(spark):
    base = dup_fixture(spark)
    # many copies of one key: a "hot" group
    hot = spark.range(5000, numPartitions=6).select(
        F.format_string("h%04d", "id").alias("transaction_id"), F.lit(9).cast("bigint").alias("account_id"),
        F.lit(1).cast("bigint").alias("category_id"), F.lit("2024-03-01").cast("date").alias("transaction_date"),
        F.lit("5.00").cast("decimal(14,2)").alias("amount"), F.lit("d").alias("description"),
        F.lit("x").alias("source_doc_ref"), F.lit(False).alias("is_duplicate_flag"),
        F.lit(None).cast("double").alias("confidence_score"),
        (F.lit("2024-03-01 00:00:00").cast("timestamp") + F.make_interval(
            mins=(F.col("id") % 37).cast("int"))).alias("created_at"))
    df = base.unionByName(hot)
    cols = ["transaction_id", "dup_group_size", "dup_rank", "is_likely_duplicate", "is_duplicate_secondary"]
    plain = rows(staging.flag_duplicates(df, hot_group_rows=None), *cols)
    split = rows(staging.flag_duplicates(df, hot_group_rows=2, hot_slices=7), *cols)
    assert plain == split
    # slice count derived from the hot rows found (about hot_group_rows rows per slice)
    assert rows(staging.flag_duplicates(df, hot_group_rows=300), *cols) == plain
    # every group of 2+ rows hot, the NULL-amount group included (null-safe keys)
    assert rows(staging.flag_duplicates(df, hot_group_rows=1, hot_slices=5), *cols) == plain
    ranks = [r[2] for r in split if r[0].startswith("h")]
    assert sorted(ranks) == list(range(1, 5001))


def test_exactly_one_primary_per_group_and_partition_independence(spark):
    df = dup_fixture(spark)
    d = staging.flag_duplicates(df)
    firsts = d.groupBy("account_id", "amount", "transaction_date").agg(
        F.sum(F.when(F.col("dup_rank") == 1, 1).otherwise(0)).alias("n1"))
    assert {r[0] for r in firsts.select("n1").collect()} == {1}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = rows(staging.flag_duplicates(df.repartition(5)), "transaction_id", "dup_rank")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert again == rows(d, "transaction_id", "dup_rank")


def test_expense_summary_traps(spark):
    d = staging.flag_duplicates(dup_fixture(spark))
    cats = spark.createDataFrame([(10, "Rent"), (20, "Rent"), (30, "Food")],
                                 "id bigint, name string")
    for max_rows in (100, 1):  # broadcast path and pre-aggregating shuffle path
        e = marts.expense_summary(d, cats, max_broadcast_rows=max_rows)
        got = {(r[0], str(r[1]), r[2]): tuple(r[3:]) for r in e.collect()}
        # ids 10 and 20 share the name Rent (trap 15); the two secondaries leave totals
        assert got[(1, "2024-01-01", "Rent")] == (2, D("120.00"), 3)
        # a group of secondaries only sums to NULL, not 0 (trap 10)
        assert got[(2, "2024-02-01", "Food")] == (0, None, 1)
        assert got[(2, "2024-02-01", "Rent")] == (1, D("30.00"), 1)
    # Σ total_amount = Σ amount of non-secondary rows
    tot = e.agg(F.sum("total_amount")).first()[0]
    assert tot == d.where(~F.col("is_duplicate_secondary")).agg(F.sum("amount")).first()[0]


def trend_fixture(spark):
    months = ["2024-01-01", "2024-02-01", "2024-03-01", "2024-05-01",   # April missing
              "2024-06-01", "2024-07-01", "2024-08-01", "2024-09-01"]
    totals = ["100.00", "100.00", None, "100.00", "100.00", "100.00", "100.00", "300.00"]
    data = [(1, "Rent", dt.date.fromisoformat(m), None if t is None else D(t)) for m, t in zip(months, totals)]
    # ratio exactly 0.30 is not a spike (strict >): avg of (100, 160) = 130, (160-130)/130 < .3
    data += [(2, "Food", dt.date(2024, 1, 1), D("100.00")), (2, "Food", dt.date(2024, 2, 1), D("130.00"))]
    # zero and negative averages are never spikes
    data += [(3, "Neg", dt.date(2024, 1, 1), D("-50.00")), (3, "Neg", dt.date(2024, 2, 1), D("10.00")),
             (4, "Zero", dt.date(2024, 1, 1), D("0.00")), (4, "Zero", dt.date(2024, 2, 1), D("0.00"))]
    return spark.createDataFrame(data, "account_id bigint, category string, month date, "
                                       "total_amount decimal(24,2)")


def test_rolling_trend_present_rows(spark):
    t = marts.category_trend(trend_fixture(spark)).where("account_id = 1")
    got = {str(r[0]): (r[1], r[2]) for r in t.select("month", "rolling_6mo_avg", "prev_month_amount").collect()}
    # Sep: the 6 preceding *present* rows are Mar..Sep minus the gap (NULL skipped by avg)
    assert got["2024-09-01"][0] == D("140.000000")     # (100*5 + 300) / ... rows May..Sep + Mar(NULL)
    assert got["2024-05-01"][1] is None                 # lag is the previous present row (NULL total)
    assert got["2024-03-01"][0] == D("100.000000")


def test_cost_spikes(spark):
    f = marts.profitability_flags(trend_fixture(spark))
    got = {(r[0], str(r[1])): (r[2], r[3], r[4]) for r in f.select(
        "account_id", "month", "pct_above_rolling_avg", "is_cost_spike", "flag_reason").collect()}
    # Sep: avg over (NULL, 100, 100, 100, 100, 300) = 140 -> (300-140)/140 = 1.142857
    assert got[(1, "2024-09-01")][0] == D("1.143")
    assert got[(1, "2024-09-01")][2] == ("Category spend 114.3% above 6-month rolling average "
                                          "— review for waste")
    assert all(k[0] == 1 for k in got)       # no flags for exact 0.30, zero or negative averages


def test_monthly_cashflow(spark):
    data = [(1, 7, dt.date(2024, 1, 3), "inflow", D("100.00"), False),
            (2, 7, dt.date(2024, 1, 9), "outflow", D("30.00"), False),
            (3, 7, dt.date(2024, 1, 9), "refund", D("5.00"), False),     # unknown type (trap 18)
            (4, 7, dt.date(2024, 1, 20), "inflow", D("1000.00"), True)]   # projected: excluded
    cf = spark.createDataFrame(data, "cashflow_event_id bigint, entity_id bigint, event_date date, "
                                     "event_type string, amount decimal(14,2), projected boolean")
    got = marts.monthly_cashflow(cf).collect()
    assert [tuple(r) for r in got] == [(7, dt.date(2024, 1, 1), D("100.00"), D("30.00"), D("65.00"))]


def test_inventory_turnover_and_slow_moving(spark):
    data = [  # sku A: two rows in Jan, one in Feb -> average of monthly averages
        (1, "A", dt.date(2024, 1, 1), 10, D("2.00"), 0.2), (1, "A", dt.date(2024, 1, 15), 20, D("4.00"), 0.4),
        (1, "A", dt.date(2024, 2, 1), 30, D("3.00"), 0.5),
        (1, "B", dt.date(2024, 1, 1), 5, D("1.00"), 0.4),                      # exactly 0.4: not slow
        (1, "C", dt.date(2024, 1, 1), 5, D("1.00"), None)]                     # all-NULL rates
    inv = spark.createDataFrame(data, "entity_id bigint, sku string, snapshot_date date, quantity int, "
                                      "unit_cost decimal(12,2), turnover_rate double")
    t = marts.inventory_turnover(inv)
    jan = t.where("sku = 'A' AND month = '2024-01-01'").first()
    assert jan["avg_qty"] == D("15.0000") and jan["inventory_value"] == D("45.0000000000")
    slow = {r[0]: tuple(r[1:]) for r in marts.slow_moving_inventory(t).select(
        "sku", "avg_turnover_rate", "avg_inventory_value", "reason").collect()}
    # A: mean of monthly rates (0.3, 0.5) = 0.4 -> not slow either; only strictly below counts
    assert slow == {}
    slow = {r["sku"]: r for r in marts.slow_moving_inventory(t, turnover_threshold=0.45).collect()}
    assert set(slow) == {"A", "B"}                     # C has no rate at all: never flagged
    assert slow["A"]["avg_turnover_rate"] == D("0.400")
    assert slow["A"]["avg_inventory_value"] == D("67.50")   # mean of 45.00 and 90.00
    assert slow["A"]["reason"] == ("Turnover rate 0.400 below threshold 0.45 — capital tied up in "
                                   "slow-moving stock")


def test_reports_push_account_filter_to_scan(spark, tmp_path):
    path = str(tmp_path / "li")
    spark.range(100).select(
        F.format_string("t%03d", "id").alias("id"), (F.col("id") % 5).alias("account_id"),
        (F.col("id") % 3).alias("category_id"), F.lit("2024-01-02").cast("date").alias("date"),
        F.lit("1.00").cast("decimal(14,2)").alias("amount"), F.lit("d").alias("description"),
        F.lit("r").alias("source_doc_ref"), F.lit(False).alias("is_duplicate_flag"),
        F.lit(None).cast("double").alias("confidence_score"),
        F.lit("2024-01-02 00:00:00").cast("timestamp").alias("created_at")).write.parquet(path)
    stg = staging.stg_transactions(spark.read.parquet(path))
    d = staging.flag_duplicates(stg, hot_group_rows=None)
    r1 = review.duplicate_report(d, account_id=3)
    plan = r1._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(account_id), EqualTo(account_id,3)]" in plan
    cats = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id bigint, name string")
    r3 = review.cost_spike_report(marts.profitability_flags(marts.expense_summary(d, cats)), account_id=3)
    plan = r3._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(account_id,3)" in plan
    assert {r[0] for r in r1.select("account_id").collect()} == {3}


def test_one_account_reports_read_that_account_only(spark):
    """With the arguments that production uses: the look for hot groups runs while the
    plan is built, so it must not read other accounts either."""
    from tesoro.plans import catalog
    sf = "/root/testdata/sf0.001"
    seen = []
    find = staging._find_hot_groups

    def spy(stg, hot_group_rows):
        seen.append(stg._jdf.queryExecution().executedPlan().toString())
        return find(stg, hot_group_rows)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(staging, "_find_hot_groups", spy)
        plans = [catalog.r1_one_account(spark, sf), catalog.r3_one_account(spark, sf)]
    texts = seen + [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(seen) == 2 and all("EqualTo(l_suppkey,7)" in t for t in texts)
    for query, column in ((catalog.s9_one_entity, "n_nationkey"), (catalog.s10_one_entity, "l_suppkey")):
        text = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert f"EqualTo({column},7)" in text or f"EqualTo(c_nationkey,7)" in text


def test_many_hot_groups_take_the_shuffle_path(spark, monkeypatch):
    df = dup_fixture(spark)
    cols = ["transaction_id", "dup_group_size", "dup_rank"]
    plain = rows(staging.flag_duplicates(df, hot_group_rows=None), *cols)
    monkeypatch.setattr(staging, "MAX_HOT_GROUPS", 0)   # nothing may be broadcast
    assert rows(staging.flag_duplicates(df, hot_group_rows=1), *cols) == plain


def test_missing_category_is_its_own_null_group(spark):
    data = [txn("a", 1, 10, "2024-01-05", "5.00", "2024-01-05 00:00:00"),
            txn("b", 1, 99, "2024-01-06", "7.00", "2024-01-06 00:00:00"),   # no such category
            txn("c", 1, 98, "2024-01-07", "1.00", "2024-01-07 00:00:00")]   # no such category
    d = staging.flag_duplicates(spark.createDataFrame(data, TXN_SCHEMA))
    cats = spark.createDataFrame([(10, "Rent")], "id bigint, name string")
    got = {r["category"]: (r["transaction_count"], r["total_amount"])
           for r in marts.expense_summary(d, cats).collect()}
    assert got == {"Rent": (1, D("5.00")), None: (2, D("8.00"))}


def test_one_big_account_with_small_groups(spark):
    # every row in one account (a one-entity feed); groups of at most 2 rows
    df = spark.range(400).select(
        F.format_string("t%04d", "id").alias("transaction_id"), F.lit(1).cast("bigint").alias("account_id"),
        F.lit(1).cast("bigint").alias("category_id"), F.lit("2024-03-01").cast("date").alias("transaction_date"),
        (F.floor(F.col("id") / 2) + 1).cast("decimal(14,2)").alias("amount"), F.lit("d").alias("description"),
        F.lit("x").alias("source_doc_ref"), F.lit(False).alias("is_duplicate_flag"),
        F.lit(None).cast("double").alias("confidence_score"),
        F.lit("2024-03-01 00:00:00").cast("timestamp").alias("created_at"))
    found, _ = staging._find_hot_groups(df, 2)
    assert found == []                                     # the account is a candidate, no group is hot
    cols = ["transaction_id", "dup_group_size", "dup_rank"]
    assert rows(staging.flag_duplicates(df, hot_group_rows=2), *cols) == \
        rows(staging.flag_duplicates(df, hot_group_rows=None), *cols)


def test_slices_of_hot_rows_are_not_smaller_than_a_task_is_worth():
    assert staging._slices(36_000_000, 400, 12) == 180   # not 90 000 tasks
    assert staging._slices(60_000, 400, 8) == 8
    assert staging._slices(1000, 400, 8) == 3
    assert staging._slices(5, 2, 8) == 3
    assert staging._slices(9_000_000, 2_000_000, 8) == 5


def test_rows_of_large_tables_are_dealt_in_proportion(spark, monkeypatch):
    df = dup_fixture(spark)
    cats = spark.createDataFrame([(10, "a"), (20, "b"), (30, "a")], "id bigint, name string")
    flags = staging.flag_duplicates(df)
    want = [rows(flags), *(rows(f(marts.expense_summary(flags, cats))) for f in (lambda e: e, marts.category_trend, marts.profitability_flags))]
    n = 2 * df.count()
    assert n > spark.sparkContext.defaultParallelism
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 0.5)
    flags = staging.flag_duplicates(df)
    assert f", {n})" in flags._jdf.queryExecution().executedPlan().toString()   # hash partitions, whatever the setting
    for limit in (100, 0):
        expense = marts.expense_summary(flags, cats, max_broadcast_rows=limit, rows=8)
        got = [rows(flags), rows(expense), rows(marts.category_trend(expense, 8)), rows(marts.profitability_flags(expense, 8))]
        assert got == want
    assert storage.dealt(df, None, "account_id") is df
