"""Silver models: P1-P3 rename projections and W5 duplicate flagging.

Renames happen here, before any window: a select that both renames a column and
windows over it keeps filters above the Window, so renaming first lets account
filters reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesoro.functions.joins import DEFAULT_MAX_BROADCAST_ROWS
from tesoro.functions.storage import dealt, stored


def stg_transactions(core_transaction: DataFrame) -> DataFrame:
    """``stg_transactions``."""
    return core_transaction.select(
        F.col("id").alias("transaction_id"),
        "account_id",
        "category_id",
        F.col("date").alias("transaction_date"),
        "amount",
        "description",
        "source_doc_ref",
        "is_duplicate_flag",
        "confidence_score",
        "created_at",
    )


def stg_cashflow(core_cashflowevent: DataFrame) -> DataFrame:
    """``stg_cashflow``."""
    return core_cashflowevent.select(
        F.col("id").alias("cashflow_event_id"),
        "entity_id",
        F.col("date").alias("event_date"),
        "event_type",
        "amount",
        "projected",
    )


def stg_inventory(core_inventorysnapshot: DataFrame) -> DataFrame:
    """``stg_inventory``."""
    return core_inventorysnapshot.select(
        F.col("id").alias("snapshot_id"),
        "entity_id",
        "sku",
        F.col("date").alias("snapshot_date"),
        F.col("qty").alias("quantity"),
        "unit_cost",
        "turnover_rate",
    )


# W1/W2 partition key and order. ``transaction_id`` breaks ties on created_at,
# which the reference leaves arbitrary (trap 13). PostgreSQL sorts NULLs last.
DUP_KEY = ("account_id", "amount", "transaction_date")


def _dup_order():
    return (F.col("created_at").asc_nulls_last(), F.col("transaction_id").asc_nulls_last())


# A duplicate group above this many rows is ranked by the split path below
# instead of one window task (at most rows/threshold groups can be that big).
# Hot rows are cut into range slices of about this many rows each, so the slice
# count grows with the hot data.
DEFAULT_HOT_GROUP_ROWS = 2_000_000
# A slice of hot rows has so many at least, unless there are fewer for each core, however
# small a group counts as hot: a task for fewer rows costs more than their ranks.
MIN_SLICE_ROWS = 200_000
# Most candidate accounts / hot groups handled with a broadcast lookup; beyond
# that the lookups are shuffle joins.
MAX_HOT_GROUPS = 100_000


def _window_flags(df: DataFrame, rows: int | None = None) -> DataFrame:
    df = dealt(df, rows, *DUP_KEY)
    ordered = Window.partitionBy(*DUP_KEY).orderBy(*_dup_order())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Same partitioning and order for both: one Exchange, one Sort, one Window.
    return (df.withColumn("dup_group_size", F.count(F.lit(1)).over(whole))
              .withColumn("dup_rank", F.row_number().over(ordered)))


def _slices(hot_rows: int, hot_group_rows: int, cores: int) -> int:
    """Slices of about ``hot_group_rows`` rows each, or of more where these would be small
    and every core has one."""
    return max(2, min(-(-hot_rows // hot_group_rows), max(cores, -(-hot_rows // MIN_SLICE_ROWS))))


def _split_hot_ranks(hot_rows: DataFrame, slices: int, broadcast_offsets: bool) -> DataFrame:
    """Exact dup_rank for rows of very large groups, spread over many tasks.

    Range-partition on (key, order): one hot group lands in consecutive slices,
    each holding a contiguous run of its order. One window gives the rank inside
    the slice and the slice size; that result is written to the shared folder once,
    so the slice offsets and the ranks are computed from the same slices even though
    range boundaries are sampled. Rank = rank inside the slice + rows of the same group in
    earlier slices. Group size comes from the count aggregate that found the
    group (column ``_n``).
    """
    ranged = (hot_rows.repartitionByRange(slices, *DUP_KEY, *_dup_order())
                      .withColumn("_slice", F.spark_partition_id()))
    in_slice = Window.partitionBy(*DUP_KEY, "_slice").orderBy(*_dup_order())
    local = (ranged
             .withColumn("_local_rank", F.row_number().over(in_slice))
             .withColumn("_slice_rows", F.count(F.lit(1)).over(
                 in_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    local = stored(local, "hot-ranks")
    per_slice = local.select(*DUP_KEY, "_slice", "_slice_rows").dropDuplicates([*DUP_KEY, "_slice"])
    offsets = per_slice.withColumn(
        "_offset",
        F.coalesce(F.sum("_slice_rows").over(
            Window.partitionBy(*DUP_KEY).orderBy("_slice")
                  .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = offsets.select(*[F.col(k).alias(f"_o_{k}") for k in DUP_KEY],
                             F.col("_slice").alias("_o_slice"), "_offset")
    if broadcast_offsets:
        # checked by the caller: at most (slices + hot groups) rows
        offsets = F.broadcast(offsets)
    cond = [local[k].eqNullSafe(offsets[f"_o_{k}"]) for k in DUP_KEY] + [
        local["_slice"] == offsets["_o_slice"]]
    joined = local.join(offsets, cond, "inner")
    return (joined.withColumn("dup_group_size", F.col("_n"))
                  .withColumn("dup_rank", (F.col("_local_rank") + F.col("_offset")).cast("int")))


# Items that Spark's frequency sketch can track, and share of the rows, times the tracked
# items, that its counts may be off.
MAX_TRACKED = 1_000_000
SKETCH_ERROR = 3.5


def _admitted_keys(stg: DataFrame, rows: int, hot_group_rows: int) -> list[int] | None:
    """Hashes of the keys that a mergeable frequency sketch admits: among them all that
    more than ``hot_group_rows`` of the ``rows`` have. None if they can be too many for
    the sketch. One scan of the key columns; a task passes on its sketch alone.

    A count is too high by the error at most, and keys whose lower bound is below the
    error may be missing; both stay below the threshold with four times as many items
    as that takes."""
    tracked = int(8 * SKETCH_ERROR * rows / hot_group_rows) + 100
    if tracked > MAX_TRACKED:
        return None
    k = min(tracked, 100_000, 2 * (rows // hot_group_rows) + 100)
    found = stg.select(F.xxhash64(*DUP_KEY).alias("_key")).agg(
        F.expr(f"approx_top_k(_key, {k}, {tracked})").alias("top")).first()["top"]
    return [r["item"] for r in found if r["count"] > hot_group_rows]


def _find_hot_groups(stg: DataFrame, hot_group_rows: int) -> tuple[list, DataFrame | None]:
    """Keys of duplicate groups with more than ``hot_group_rows`` rows, with sizes.

    A table of no more rows has none: its rows are counted first, which reads the files'
    footers only. Else a frequency sketch admits keys in one scan (usually none), and
    only these are counted exactly. Where hot groups can be too many for the sketch, the
    accounts are counted (a group that big lies in an account that big; one row for each
    account and task is shuffled), then the full keys of the candidates. At most
    MAX_HOT_GROUPS + 1 small rows come back to the driver per step.
    Returns (collected rows, the full lazy table of hot keys and sizes).
    """
    rows = stg.count()
    if rows <= hot_group_rows:
        return [], None
    spark, acct = stg.sparkSession, DUP_KEY[0]
    admitted = _admitted_keys(stg, rows, hot_group_rows)
    if admitted is not None:
        if not admitted:
            return [], None
        keys = F.broadcast(spark.createDataFrame([(k,) for k in admitted], "_key long"))
        scope = stg.join(keys, F.xxhash64(*[stg[k] for k in DUP_KEY]) == keys["_key"], "left_semi")
    else:
        accounts = (stg.groupBy(acct).agg(F.count(F.lit(1)).alias("_an"))
                       .where(F.col("_an") > hot_group_rows).select(F.col(acct).alias("_c_acct")))
        candidates = accounts.limit(MAX_HOT_GROUPS + 1).collect()
        if not candidates:
            return [], None
        scope = stg
        if len(candidates) <= MAX_HOT_GROUPS:
            cand = F.broadcast(spark.createDataFrame(candidates, accounts.schema))
            scope = stg.join(cand, stg[acct].eqNullSafe(cand["_c_acct"]), "left_semi")
    sizes = scope.groupBy(*DUP_KEY).agg(F.count(F.lit(1)).alias("_n"))
    hot = (sizes.where(F.col("_n") > hot_group_rows)
                .select(*[F.col(k).alias(f"_h_{k}") for k in DUP_KEY], "_n"))
    return hot.limit(MAX_HOT_GROUPS + 1).collect(), hot


def flag_duplicates(stg: DataFrame, hot_group_rows: int | None = DEFAULT_HOT_GROUP_ROWS,
                    hot_slices: int | None = None) -> DataFrame:
    """W5 = W1 + W2 + P10: ``stg_transactions_deduped``.

    Adds dup_group_size (rows sharing account, amount and date), dup_rank
    (1 = first by created_at, then transaction_id), is_likely_duplicate
    (size > 1) and is_duplicate_secondary (rank > 1).

    With ``hot_group_rows`` set, :func:`_find_hot_groups` finds groups bigger
    than that (at most rows/hot_group_rows of them; only their keys are
    collected). With none, this is the plain windowed plan: one shuffle on the
    key, shared by both windows. Otherwise ordinary groups keep that plan and
    hot groups are ranked by :func:`_split_hot_ranks`, so no single task holds
    a whole group. ``hot_group_rows=None`` skips the check. The rows are dealt over tasks
    in proportion to their number (``storage.dealt``).
    """
    cols = stg.columns
    flagged = rows = None
    if hot_group_rows is not None:
        found, hot_all = _find_hot_groups(stg, hot_group_rows)
        rows = stg.count()
        if found:
            small = len(found) <= MAX_HOT_GROUPS
            if hot_slices is None:
                hot_total = (sum(r["_n"] for r in found) if small
                             else hot_all.agg(F.sum("_n")).first()[0])
                hot_slices = _slices(hot_total, hot_group_rows, stg.sparkSession.sparkContext.defaultParallelism)
            # offsets have one row per (hot group, slice it spans) <= slices + groups
            small_offsets = small and hot_slices + len(found) <= DEFAULT_MAX_BROADCAST_ROWS
            spark = stg.sparkSession
            hot_schema = ", ".join([f"_h_{k} {stg.schema[k].dataType.simpleString()}"
                                    for k in DUP_KEY] + ["_n bigint"])
            # the collected keys when few (broadcast), else the full table (shuffle join)
            lookup = F.broadcast(spark.createDataFrame(found, hot_schema)) if small else hot_all
            cond = [stg[k].eqNullSafe(lookup[f"_h_{k}"]) for k in DUP_KEY]
            tagged = stg.join(lookup, cond, "left").drop(*[f"_h_{k}" for k in DUP_KEY])
            cold = _window_flags(tagged.where(F.col("_n").isNull()), rows)
            warm = _split_hot_ranks(tagged.where(F.col("_n").isNotNull()), hot_slices,
                                    small_offsets)
            keep = [*cols, "dup_group_size", "dup_rank"]
            flagged = cold.select(*keep).unionByName(warm.select(*keep))
    if flagged is None:
        flagged = _window_flags(stg, rows)
    return (flagged.select(*cols, "dup_group_size", "dup_rank")
                   .withColumn("is_likely_duplicate", F.col("dup_group_size") > 1)
                   .withColumn("is_duplicate_secondary", F.col("dup_rank") > 1))
