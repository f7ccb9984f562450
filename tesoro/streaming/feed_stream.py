"""Incremental feed ingestion with Structured Streaming.

The reference loads its JSON feed on a daily schedule. Here new feed files are
picked up as they land by a file-source stream (whole files, as each is one
JSON array), parsed and appended to Bronze in ``foreachBatch``.

Exactly-once: the stream's checkpoint records which files were processed, and a
micro-batch is a load of its own in Bronze: replayed after a failure it finds the ids of
other loads, adds the same rows and replaces what the first attempt has written. ``trigger(availableNow=True)`` processes what is there and stops, which
is how a scheduled run uses it; a continuous trigger works unchanged. All feed
kinds go through one stream, so each Bronze table has a single writer.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesoro.plans.daily import append_bronze, read_bronze
from tesoro.sources import feed

KINDS = ("transactions", "cashflow", "inventory")


def _batch_loader(spark: SparkSession, warehouse: str, stream: str, load_ts):
    def load(batch: DataFrame, batch_id: int) -> None:
        name = f"stream-{stream}-{batch_id}"
        parts = {kind: feed.parse_feed_files(batch.where(F.col("_kind") == kind), kind)
                 for kind in KINDS}
        _, added = feed.load_records(spark, parts["transactions"], parts["cashflow"],
                                     parts["inventory"], read_bronze(spark, warehouse, name), load_ts)
        append_bronze(added, warehouse, name)
    return load


def start_feed_stream(spark: SparkSession, feed_root: str, warehouse: str,
                      checkpoint_location: str, load_ts, available_now: bool = True):
    """Start the stream over ``feed_root/<kind>/*.json`` (kind = transactions,
    cashflow or inventory, from the folder name).

    Returns the StreamingQuery; with ``available_now`` it stops after the files
    present at start are loaded (call ``awaitTermination``).
    """
    files = (spark.readStream.option("maxFilesPerTrigger", 1000)
             .text(f"{feed_root.rstrip('/')}/*/", wholetext=True)
             .select(F.col("_metadata.file_path").alias("_source_file"), "value")
             .withColumn("_kind", F.regexp_extract("_source_file", r"/([^/]+)/[^/]+$", 1)))
    stream = hashlib.sha256(checkpoint_location.encode()).hexdigest()[:16]
    writer = (files.writeStream
              .foreachBatch(_batch_loader(spark, warehouse.rstrip("/"), stream, load_ts))
              .option("checkpointLocation", checkpoint_location)
              .queryName("feed_load"))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
