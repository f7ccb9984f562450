"""SURVEY 5 properties and plan checks on the driver tables (sf0.001)."""

from pyspark.sql import functions as F

from conftest import rows
from tesoro.plans import catalog

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "PythonUDF")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_net_is_inflow_minus_outflow(spark):
    m = catalog.cashflow_mart(spark, SF)
    bad = m.where(F.col("net_cashflow") != F.col("total_flow") - F.col("total_outflow"))
    assert bad.count() == 0 and m.count() > 0


def test_results_do_not_depend_on_shuffle_partitions(spark):
    base = {q: rows(catalog.QUERIES[q](spark, SF))
            for q in ("r2_cost_spikes", "a2_expense_summary", "n2_slow_moving", "t3_calculate_tax")}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for q, expected in base.items():
            assert rows(catalog.QUERIES[q](spark, SF)) == expected, q
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_marts_and_tax_have_no_python(spark):
    for q in ("a1_monthly_cashflow", "w5_duplicate_flags", "a2_expense_summary", "r2_cost_spikes",
              "a3_inventory_turnover", "n2_slow_moving", "t1_iva", "t2_isr", "t3_calculate_tax",
              "j3_asof_rule_set"):
        plan = _plan(catalog.QUERIES[q](spark, SF))
        assert not any(node in plan for node in PYTHON_NODES), q
    # the grouped maps are the only Python, and they follow one exchange on the entity
    plan = _plan(catalog.QUERIES["f1_forecast"](spark, SF))
    assert "FlatMapGroupsInPandas" in plan


def test_projection_and_filter_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = _plan(catalog.QUERIES["a1_monthly_cashflow"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line and "orders" in line][0]
    read_schema = scan.split("ReadSchema: ")[1]
    assert "o_orderkey" not in read_schema                 # pruned: A1 never reads it
    assert "Not(EqualTo(o_orderstatus,P))" in scan        # P6 pushed into the scan


def test_duplicate_windows_share_one_exchange_and_sort(spark):
    from tesoro.operators import staging
    from tesoro.sources import driver_tables as dt
    stg = staging.stg_transactions(dt.transactions(spark, SF))
    plan = _plan(staging.flag_duplicates(stg, hot_group_rows=None))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    assert plan.count("Window [") == 1
