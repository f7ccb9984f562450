"""Gold marts: A1-A4, W3/W4, R2, N2.

No mart sorts its output (O1): a global ORDER BY is a range shuffle whose order
a consumer cannot rely on anyway; reports sort on delivery (review.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesoro.functions.columns import (
    TURNOVER, cents, month_start, quantize_half_even, ratio_thousandths, scaled_decimal)
from tesoro.functions.joins import DEFAULT_MAX_BROADCAST_ROWS, bounded_broadcast
from tesoro.functions.storage import dealt


def monthly_cashflow(stg_cashflow: DataFrame) -> DataFrame:
    """A1: ``mart_monthly_cashflow`` (P6 actuals only, X1, X2).

    total_flow is the inflow total. An event type that is neither inflow nor
    outflow lowers net but is in neither total (trap 18). Partial aggregation
    runs map-side, so a hot entity is combined before the shuffle.
    """
    is_in = F.col("event_type") == F.lit("inflow")
    is_out = F.col("event_type") == F.lit("outflow")
    amount = F.col("amount")
    return (stg_cashflow
            .where(~F.col("projected"))
            .groupBy("entity_id", month_start("event_date").alias("month"))
            .agg(F.sum(F.when(is_in, amount).otherwise(F.lit(0))).alias("total_flow"),
                 F.sum(F.when(is_out, amount).otherwise(F.lit(0))).alias("total_outflow"),
                 F.sum(F.when(is_in, amount).otherwise(-amount)).alias("net_cashflow")))


def _expense_aggs(count_col: str | None = None, sum_col: str | None = None,
                  flagged_col: str | None = None):
    if count_col is None:
        keep = ~F.col("is_duplicate_secondary")
        return [F.count_if(keep).alias("transaction_count"),
                # no otherwise(): a group of secondaries only sums to NULL (trap 10)
                F.sum(F.when(keep, F.col("amount"))).alias("total_amount"),
                F.count_if(F.col("is_likely_duplicate")).alias("flagged_duplicate_count")]
    return [F.sum(count_col).cast("bigint").alias("transaction_count"),
            F.sum(sum_col).cast("decimal(24,2)").alias("total_amount"),
            F.sum(flagged_col).cast("bigint").alias("flagged_duplicate_count")]


def expense_summary(deduped: DataFrame, categories: DataFrame,
                    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """A2 + J1: ``mart_expense_summary`` by account, month and category *name*.

    Ids sharing a name merge; a transaction without a category is its own NULL
    group (trap 15). When the category table is provably small it is broadcast
    and the join costs no shuffle. Otherwise transactions are first
    pre-aggregated per (account, month, category id), so only partial rows go
    through the shuffle join, and re-aggregated by name. If the number of transactions
    ``rows`` is given and large, the rows of a group are dealt over tasks in proportion to it.
    """
    txns = deduped.select(
        "account_id", month_start("transaction_date").alias("month"), "category_id",
        "amount", "is_duplicate_secondary", "is_likely_duplicate")
    cats = categories.select(F.col("id").alias("_cat_id"), F.col("name").alias("category"))
    cats, small = bounded_broadcast(cats, max_broadcast_rows)
    if small:
        joined = txns.join(cats, txns.category_id == cats._cat_id, "left")
        return dealt(joined, rows, "account_id", "month", "category").groupBy("account_id", "month", "category").agg(*_expense_aggs())
    pre = dealt(txns, rows, "account_id", "month", "category_id").groupBy("account_id", "month", "category_id").agg(
        *[a.alias(f"_p{i}") for i, a in enumerate(_expense_aggs())])
    joined = dealt(pre, rows, "category_id").join(cats, pre.category_id == cats._cat_id, "left")
    return dealt(joined, rows, "account_id", "month", "category").groupBy("account_id", "month", "category").agg(
        *_expense_aggs("_p0", "_p1", "_p2"))


def _trend_window():
    return Window.partitionBy("account_id", "category").orderBy(F.col("month").asc_nulls_last())


def category_trend(expense: DataFrame, rows: int | None = None) -> DataFrame:
    """W3 + W4: rolling average over the current and 5 preceding *present* months
    (no calendar gap filling, trap 9; the current month is included, trap 19)
    and the previous present month's total.

    The window input is the aggregated mart (one row per account, category and
    month), so a window partition holds at most one row per calendar month. ``rows`` as
    in :func:`expense_summary`.
    """
    w = _trend_window()
    frame = w.rowsBetween(-5, 0)
    return dealt(expense, rows, "account_id", "category").select(
        "account_id", "category", "month", "total_amount",
        F.avg("total_amount").over(frame).alias("rolling_6mo_avg"),
        F.lag("total_amount", 1).over(w).alias("prev_month_amount"),
    )


# The spike threshold (30 % above the rolling average, written as the
# exact ratio 13/10 used in the integer comparison below) and the flag text around
# the rounded percentage.
SPIKE_RATIO_NUM, SPIKE_RATIO_DEN = 13, 10
FLAG_REASON_PREFIX = "Category spend "
FLAG_REASON_SUFFIX = "% above 6-month rolling average — review for waste"


def profitability_flags(expense: DataFrame, rows: int | None = None) -> DataFrame:
    """R2: ``mart_profitability_flags`` (W3 -> guarded pct -> P9 -> X4/X6 text).

    Exact arithmetic: with T the month's total, S the window sum and n the count
    of non-NULL totals in the frame, pct = (T*n - S) / S. In cents this is an
    integer ratio, so the spike test ``pct > 0.30`` is ``10*T*n > 13*S`` and the
    rounded percentage is computed from BIGINTs, half away from zero like
    PostgreSQL's numeric round. The guard ``rolling avg > 0`` is ``S > 0``. ``rows`` as in
    :func:`expense_summary`.
    """
    w = _trend_window().rowsBetween(-5, 0)
    t = cents("total_amount")
    s = cents(F.col("_s"))
    n = F.col("_n")
    base = dealt(expense, rows, "account_id", "category").select(
        "account_id", "category", "month", "total_amount",
        F.avg("total_amount").over(w).alias("rolling_6mo_avg"),
        F.sum("total_amount").over(w).alias("_s"),
        F.count("total_amount").over(w).alias("_n"),
    )
    positive = F.col("_s") > 0
    spike = positive & (t * n * SPIKE_RATIO_DEN > s * SPIKE_RATIO_NUM)
    thousandths = ratio_thousandths(t * n - s, s)
    flagged = base.where(spike).withColumn("_th", thousandths)
    return flagged.select(
        "account_id", "category", "month", "total_amount", "rolling_6mo_avg",
        scaled_decimal(F.col("_th"), 3).alias("pct_above_rolling_avg"),
        F.lit(True).alias("is_cost_spike"),
        F.concat(F.lit(FLAG_REASON_PREFIX),
                 scaled_decimal(F.col("_th"), 1).cast("string"),
                 F.lit(FLAG_REASON_SUFFIX)).alias("flag_reason"),
    )


def inventory_turnover(stg_inventory: DataFrame) -> DataFrame:
    """A3: ``mart_inventory_turnover`` by entity, sku and month.

    Quantity is averaged as a decimal, as PostgreSQL's avg(int) is numeric
    (trap 17). Turnover rates are floats in the data model; they are averaged as
    exact DECIMAL(18,6) so that sums do not depend on partition order and the
    strict ``< 0.4`` test of N2 cannot flip on rounding noise.
    """
    qty = F.col("quantity").cast("decimal(10,0)")
    return (stg_inventory
            .groupBy("entity_id", "sku", month_start("snapshot_date").alias("month"))
            .agg(F.avg(qty).alias("avg_qty"),
                 F.avg(F.col("turnover_rate").cast(TURNOVER)).alias("avg_turnover_rate"),
                 (F.avg("unit_cost") * F.avg(qty)).alias("inventory_value")))


def sku_turnover_summary(turnover: DataFrame) -> DataFrame:
    """A4: per (entity, sku) mean of monthly rates and values and months tracked
    (an average of monthly averages, not a row-weighted mean)."""
    return turnover.groupBy("entity_id", "sku").agg(
        F.avg("avg_turnover_rate").alias("avg_turnover_rate"),
        F.avg("inventory_value").alias("avg_value"),
        F.count("month").alias("months_tracked"),
        F.sum("avg_turnover_rate").alias("_rate_sum"),
        F.count("avg_turnover_rate").alias("_rate_n"),
    )


# The default slow-moving threshold and the reason text around the
# rounded rate and the threshold.
DEFAULT_TURNOVER_THRESHOLD = 0.4
SLOW_REASON_PREFIX = "Turnover rate "
SLOW_REASON_MIDDLE = " below threshold "
SLOW_REASON_SUFFIX = " — capital tied up in slow-moving stock"


def slow_moving_inventory(turnover: DataFrame,
                          turnover_threshold: float = DEFAULT_TURNOVER_THRESHOLD) -> DataFrame:
    """N2 = A4 + P13: SKUs whose mean monthly turnover is strictly below the
    threshold, with rounded figures and the reason text (X9).

    The threshold test compares the exact sum with threshold * count. Rounding
    is half-even, which is what Python's round/format give on these values.
    """
    summary = sku_turnover_summary(turnover)
    thr = F.lit(str(turnover_threshold)).cast("decimal(18,6)")
    flagged = summary.where((F.col("_rate_sum") < thr * F.col("_rate_n"))
                            & (F.col("months_tracked") > 0))
    rate3 = quantize_half_even("avg_turnover_rate", 3).cast("decimal(20,3)")
    return flagged.select(
        "entity_id", "sku",
        rate3.alias("avg_turnover_rate"),
        quantize_half_even("avg_value", 2).cast("decimal(24,2)").alias("avg_inventory_value"),
        F.concat(F.lit(SLOW_REASON_PREFIX), rate3.cast("string"),
                 F.lit(f"{SLOW_REASON_MIDDLE}{turnover_threshold}{SLOW_REASON_SUFFIX}")
                 ).alias("reason"),
    )
