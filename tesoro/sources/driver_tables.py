"""S2 on the driver's parquet tables: reference-shaped Bronze views.

The reference reads six PostgreSQL tables filled from a JSON feed. The test
harness instead provides TPC-H-like parquet tables; these functions map them to
the same Bronze shapes so every operator runs unchanged on either source.

Ids keep their native BIGINT type (the JSON-feed path uses string UUID-like ids):
filters on ``account_id``/``entity_id`` then reach the parquet scan as
``PushedFilters`` instead of stopping at a cast.

Every function only selects and renames; Catalyst prunes unused columns down to
the scan (``ReadSchema``) and pushes filters through.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesoro.functions.columns import UNIT_COST, money
from tesoro.functions.storage import remove
from tesoro.session import ensure_checkpoint_dir

# Fixed values of the mapping: which order priorities count as inflows,
# which order status counts as projected, which part sizes have a category.
INFLOW_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
PROJECTED_STATUS = "P"
MAX_CATEGORISED_PART_SIZE = 40


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Source-table scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cashflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """core_cashflowevent from orders joined to their customer (entity = nation)."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_nationkey").alias("entity_id"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderpriority").isin(*INFLOW_PRIORITIES), F.lit("inflow"))
         .otherwise(F.lit("outflow")).alias("event_type"),
        money("o_totalprice").alias("amount"),
        (F.col("o_orderstatus") == F.lit(PROJECTED_STATUS)).alias("projected"),
    )


def _lineitem_id() -> F.Column:
    # (l_orderkey, l_linenumber) repeats in the driver data; with l_partkey and the
    # price the tuple is unique.
    # Zero-padded, so that the string order of ids is the order of that tuple
    # (the tie-break of the duplicate rank).
    return F.concat_ws(
        "-",
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0"),
        F.lpad(F.col("l_linenumber").cast("string"), 4, "0"),
        F.lpad(F.col("l_partkey").cast("string"), 12, "0"),
        # the price as whole cents: a BIGINT renders much faster than a DECIMAL
        F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 14, "0"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """core_transaction from lineitem (account = supplier, category = part)."""
    li = read_table(spark, sf_dir, "lineitem")
    tid = _lineitem_id()
    return li.select(
        tid.alias("id"),
        F.col("l_suppkey").alias("account_id"),
        F.col("l_partkey").alias("category_id"),
        F.to_date("l_shipdate").alias("date"),
        money("l_quantity").alias("amount"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string"),
                 F.lit(" line "), F.col("l_linenumber").cast("string")).alias("description"),
        tid.alias("source_doc_ref"),
        F.lit(False).alias("is_duplicate_flag"),
        F.lit(None).cast("double").alias("confidence_score"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """core_category from part: six type names shared by many ids (trap 15)."""
    part = read_table(spark, sf_dir, "part")
    return part.where(F.col("p_size") <= MAX_CATEGORISED_PART_SIZE).select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("name"),
        F.lit(None).cast("bigint").alias("parent_id"),
    )


def inventory_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """core_inventorysnapshot from lineitem (entity = supplier, sku = part)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        _lineitem_id().alias("id"),
        F.col("l_suppkey").alias("entity_id"),
        F.col("l_partkey").alias("sku"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_extendedprice").cast(UNIT_COST).alias("unit_cost"),
        (F.col("l_discount") * F.lit(10)).alias("turnover_rate"),
    )


def order_tax_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts to tax: order totals, as of the order date; every fifth customer's orders
    are of another jurisdiction."""
    orders = read_table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.when(F.col("o_custkey") % 5 == 0, F.lit("US")).otherwise(F.lit("MX")).alias("jurisdiction"),
        money("o_totalprice").alias("amount"),
        F.to_date("o_orderdate").alias("as_of_date"),
    )


def customer_incomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly incomes to tax: customer balances (some are <= 0: no bracket)."""
    customer = read_table(spark, sf_dir, "customer")
    return customer.select("c_custkey", money("c_acctbal").alias("amount"))


def customer_entities_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity records as a feed would carry them: one per order, keyed by rfc."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "inner").select(
        F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("rfc"),
        F.col("c_name").alias("name"),
        F.to_date("o_orderdate").alias("feed_date"),
    )


def events_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the JSON ``props`` text column."""
    return read_table(spark, sf_dir, "events").select("event_id", "props")


def _over_all_cores(df: DataFrame) -> DataFrame:
    """Rows dealt anew where a table is in fewer pieces than there are cores: parsing a
    file is far more work than reading its row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a task as the lines of one JSON array."""
    begun = False
    for batch in batches:
        records = batch.column(0)
        for before, some in ((",", records),) if begun else (("[", records[:1]), (",", records[1:])):
            if len(some):
                begun = True
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(before, some, "")], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"])], ["value"])


# The invoices of a line item take some 460 bytes as text, many times what it takes in its table. So they are
# there for an eighth of the table at a time, or for six million line items (3 GB) where that is more: each part
# reads the table anew, and one of few ranges leaves cores idle.
INVOICE_PARTS, ROWS_PER_INVOICE_PART = 8, 6_000_000


def invoice_arrays(spark: SparkSession, sf_dir: str) -> Iterator[str]:
    """``lineitem`` as JSON-array files of many invoices each in the shared folder: the path of each part of
    the table. A part is written when it is asked for, and removed when the next one is."""
    rows = read_table(spark, sf_dir, "lineitem").count()  # from the files' footers
    parts = max(1, min(INVOICE_PARTS, -(-rows // ROWS_PER_INVOICE_PART)))
    for part in range(parts):
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/invoices-{uuid4().hex}"
        files = feed_files(spark, sf_dir, part, parts)["transactions"]
        records = files.select(F.expr("substring(value, 2, length(value) - 2)").alias("value"))  # both copies, without brackets
        try:
            records.mapInArrow(_as_arrays, "value string").write.text(path)
            yield path
        finally:
            remove(spark, path)


def _part_of(table: DataFrame, part: int, parts: int) -> DataFrame:
    """The rows whose place in their file is ``part`` modulo ``parts``, whatever tasks read them."""
    return table.where(F.col("_metadata.row_index") % parts == part) if parts > 1 else table


def feed_files(spark: SparkSession, sf_dir: str, part: int = 0, parts: int = 1) -> dict[str, DataFrame]:
    """The whole tables as JSON feed files ``(_source_file, value)`` by kind: one file for
    each line item (an invoice that is there twice, and an inventory snapshot) and for
    each order (a cash-flow record). By default the one part is all of them."""
    li, orders = (_over_all_cores(_part_of(read_table(spark, sf_dir, t), part, parts).select(*columns)) for t, columns in (
        ("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag",
                      "l_quantity", "l_discount")),
        ("orders", ("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice"))))
    li = li.withColumn("_uuid", _lineitem_id())
    uuid, rfc = F.col("_uuid"), F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 11, "0"))
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    invoice = F.struct(
        uuid.alias("uuid"), day.alias("fecha_emision"), rfc.alias("rfc_receptor"),
        F.array(F.struct(F.col("l_returnflag").alias("categoria"),
                         F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("descripcion")),
                F.struct(F.lit("second").alias("categoria"), F.lit("ignored").alias("descripcion"))).alias("conceptos"),
        money("l_quantity").alias("total"))
    stock = F.struct(
        rfc.alias("entity_rfc"), F.col("l_partkey").cast("string").alias("sku"), day.alias("date"),
        F.col("l_quantity").cast("int").alias("qty"), F.col("l_extendedprice").cast(UNIT_COST).alias("unit_cost"),
        F.col("l_discount").alias("turnover_rate"))
    flow = F.struct(
        F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 11, "0")).alias("entity_rfc"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderpriority").isin(*INFLOW_PRIORITIES), F.lit("inflow")).otherwise(F.lit("outflow")).alias("type"),
        money("o_totalprice").alias("amount"))
    return {
        "transactions": li.select(uuid.alias("_source_file"), F.to_json(invoice).alias("_one")).select(
            "_source_file", F.concat(F.lit("["), "_one", F.lit(","), "_one", F.lit("]")).alias("value")),
        "inventory": li.select(uuid.alias("_source_file"), F.to_json(F.array(stock)).alias("value")),
        "cashflow": orders.select(F.col("o_orderkey").cast("string").alias("_source_file"),
                                  F.to_json(F.array(flow)).alias("value")),
    }
