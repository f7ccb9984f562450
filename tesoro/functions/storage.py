"""Intermediate results in the shared folder that the cluster names, and rows dealt over tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tesoro.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: a lineage cut that
    survives lost executors, with columns pruned and filters pushed on each reading."""
    spark = df.sparkSession
    uri = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def stored_in_turn(spark: SparkSession, parts: Iterable[DataFrame], name: str) -> DataFrame:
    """As :func:`stored` for the rows of all ``parts``, which have the same columns: each is written
    before the next is asked for. With zstd, as all of them lie there together."""
    uri, schema = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", None
    for part in parts:
        part.write.option("compression", "zstd").mode("append").parquet(uri)
        schema = part.schema
    if schema is None:
        raise ValueError("nothing to store")
    return spark.read.schema(schema).parquet(uri)


def remove(spark: SparkSession, uri: str) -> None:
    """A folder of the job's own that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(uri)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# Rows that one task sorts or groups at a time: some 100 MB.
ROWS_PER_TASK = 250_000


def tasks_for(df: DataFrame, rows: int | None) -> int | None:
    """Tasks of about ROWS_PER_TASK rows for ``rows``; None where the cores are enough, or
    ``rows`` is unknown."""
    tasks = int(-(-(rows or 0) // ROWS_PER_TASK))
    return tasks if tasks > df.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows shuffled by ``keys`` to so many tasks that one holds about
    ROWS_PER_TASK, whatever the number of shuffle partitions, and adaptive execution merges
    none of them. Left as it is where the cores are enough, or ``rows`` is unknown."""
    tasks = tasks_for(df, rows)
    return df.repartition(tasks, *keys) if tasks else df
