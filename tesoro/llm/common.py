"""Helpers shared by the training-data operators: session preparation, the shared
folder, lineage cuts and memory-bounded Arrow batches.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tesoro.session import ensure_checkpoint_dir, ship_package

# Text bytes that one step of a Python worker holds at a time (a single longer
# document is a step of its own).
STEP_BYTES = 2 * 1024 * 1024
# Bytes of an Arrow batch, unless the session sets its own: Spark's default suits short
# rows, and a worker holds a batch on both sides of the pipe.
BATCH_BYTES = "8388608b"
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

# Name of the text among columns that a caller keeps.
BODY = "__text__"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder set, the package importable in Python workers, and Arrow batches
    of a size for long texts."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(_BATCH_SETTING, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lineage cut that
    survives lost executors."""
    uri = shared_uri(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside go as each of them ends: for loops of
    queries whose results are written, so that disk holds one step's shuffle at a time."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mounted_path(uri: str) -> str:
    """The path under which every worker sees a folder of the shared store.

    Files that workers write or map themselves need a mounted shared store
    (NFS, FUSE, ...), so any scheme but ``file`` raises ValueError.
    """
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the shared folder must be mounted on every worker, got {uri}")
    return unquote(parts.path)


def write_file(path: str, *chunks: bytes) -> None:
    """Write a file whole or not at all: a retried or speculative task replaces
    the file by one of equal content."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        for chunk in chunks:
            f.write(chunk)
    os.replace(part, path)


def map_file(path: str, kind: str) -> np.ndarray:
    """A file as a mapped array; empty if there is none. No file handle stays open; the
    map lasts as long as the array (``MapCache`` bounds their number)."""
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.zeros(0, dtype=kind)
    options = {"trackfd": False} if sys.version_info >= (3, 13) else {}
    with open(path, "rb") as f:
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **options), dtype=kind)


class MapCache:
    """Mapped files by path, the last ``limit`` used: a process may hold some 65 000 maps."""

    def __init__(self, kind: str, limit: int = 1024):
        self.kind, self.limit = kind, limit
        self._maps: OrderedDict[str, np.ndarray] = OrderedDict()

    def __getitem__(self, path: str) -> np.ndarray:
        if path in self._maps:
            self._maps.move_to_end(path)
        else:
            self._maps[path] = map_file(path, self.kind)
            if len(self._maps) > self.limit:
                self._maps.popitem(last=False)  # unmapped with its last view
        return self._maps[path]

    def __getstate__(self):
        return {**self.__dict__, "_maps": OrderedDict()}


def steps(batches: Iterator[pa.RecordBatch], sized: str, limit: int = STEP_BYTES
          ) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``limit`` bytes of the
    binary or string column ``sized``; a longer row is a slice of its own."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(sized))
        sizes = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
        first = held = 0
        for i, n in enumerate(sizes):
            if i > first and held + n > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)


def values(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()
