"""Report reads over the marts: S9, S10, R1, R3, R4.

Each report takes an optional id filter (P8) that is added to the lazy plan, so
Catalyst pushes it through the windows and aggregates down to the scan. Sorts
name their NULL placement explicitly: PostgreSQL puts NULLs last on ASC and
first on DESC, Spark the other way round (trap 16). The reference leaves rows of one
month or date and amount in any order; unique keys after them fix it, and let the range
sort split equal months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesoro.functions.storage import stored, tasks_for


def with_position(df: DataFrame, *order, rows: int | None = None) -> DataFrame:
    """O2: ``df`` with ``position``, the row's number from 1 in a total order, in that order.

    The rows are range-partitioned by the order and stored with their slice, so that the
    sampled boundaries are fixed; a row's number is its rank within the slice plus the
    rows of the slices before: no task holds more than a slice, and only one count for each
    slice is summed up in one place. ``rows``, if given, is the most rows that ``df`` can have:
    slices follow it where they are more than the cores.
    """
    tasks = tasks_for(df, rows)
    many = (tasks,) if tasks else ()
    slices = stored(df.repartitionByRange(*many, *order).withColumn("_slice", F.spark_partition_id()), "positions")
    within = slices.withColumn("_rank", F.row_number().over(Window.partitionBy("_slice").orderBy(*order)))
    counts = slices.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_slice", (F.sum("_rows").over(Window.orderBy("_slice")) - F.col("_rows")).alias("_before"))
    out = within.join(F.broadcast(before), "_slice").select(*df.columns, (F.col("_rank") + F.col("_before")).alias("position"))
    return out.repartitionByRange(tasks, "position").sortWithinPartitions("position") if tasks else out.orderBy("position")


def _maybe_filter(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.where(F.col(column) == F.lit(value))


def _ordered(df: DataFrame, numbered: bool, *order, rows: int | None = None) -> DataFrame:
    return with_position(df, *order, rows=rows) if numbered else df.orderBy(*order)


def monthly_cashflow_read(mart: DataFrame, entity_id=None, numbered: bool = False) -> DataFrame:
    """Monthly cash flow by month; ``total_flow`` is read as ``total_inflow``. All
    reports add the ``position`` of each row if ``numbered``."""
    df = _maybe_filter(mart, "entity_id", entity_id)
    cols = ([] if entity_id is not None else ["entity_id"]) + [
        "month", F.col("total_flow").alias("total_inflow"), "total_outflow", "net_cashflow"]
    order = ([] if entity_id is not None else [F.col("entity_id").asc_nulls_last()]) + [
        F.col("month").asc_nulls_last()]
    return _ordered(df.select(*cols), numbered, *order)


def inventory_turnover_read(mart: DataFrame, entity_id=None, numbered: bool = False) -> DataFrame:
    """Inventory turnover by sku and month."""
    df = _maybe_filter(mart, "entity_id", entity_id)
    cols = ([] if entity_id is not None else ["entity_id"]) + [
        "sku", "month", "avg_qty", "avg_turnover_rate", "inventory_value"]
    order = ([] if entity_id is not None else [F.col("entity_id").asc_nulls_last()]) + [
        F.col("sku").asc_nulls_last(), F.col("month").asc_nulls_last()]
    return _ordered(df.select(*cols), numbered, *order)


def duplicate_report(deduped: DataFrame, account_id=None, numbered: bool = False) -> DataFrame:
    """Likely duplicates (P7), optionally for one account (P8), by date, amount."""
    df = _maybe_filter(deduped.where(F.col("is_likely_duplicate")), "account_id", account_id)
    return _ordered(df.select("transaction_id", "account_id", "transaction_date", "amount", "description", "dup_group_size", "dup_rank"),
                    numbered, F.col("transaction_date").asc_nulls_last(), F.col("amount").asc_nulls_last(),
                    F.col("account_id").asc_nulls_last(), F.col("dup_rank"))


def cost_spike_report(flags: DataFrame, account_id=None, numbered: bool = False, rows: int | None = None) -> DataFrame:
    """Cost-spike flags, optionally for one account, newest month first. ``rows`` as in
    :func:`with_position`."""
    df = _maybe_filter(flags, "account_id", account_id)
    return _ordered(df.select("account_id", "category", "month", "total_amount", "rolling_6mo_avg", "pct_above_rolling_avg", "flag_reason"),
                    numbered, F.col("month").desc_nulls_first(), F.col("account_id").asc_nulls_last(),
                    F.col("category").asc_nulls_last(), rows=rows)


def normalization_review(deduped: DataFrame, flags: DataFrame, account_id=None) -> dict:
    """R4 = R1 + R3."""
    return {"likely_duplicates": duplicate_report(deduped, account_id),
            "cost_spike_flags": cost_spike_report(flags, account_id)}
