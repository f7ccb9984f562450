"""Exact top-k inner-product search by distributed histogram selection.

Every pass scores all candidates against a block of queries. The first passes build
global histograms of the scores and narrow each query's range to the bin that holds its
k-th highest score, until that bin is one integer wide. The last pass keeps what reaches
the k-th score, and ties are broken by the smaller id.

A task sends a query's histogram only down to the bin of the task's own k-th score: the
global k-th score can't lie lower. In the last pass it sends its own k best only. So
what is shuffled is bounded by k a query and task, however many rows tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesoro.llm.common import prepare, read, shared_uri

K = 5
SCALE = 256
QUERY_STEP = 50
# Queries of one round of passes: the bound of what is broadcast.
BLOCK_QUERIES = 4096
BINS = 1024
# Candidates that a task scores at a time.
CHUNK = 1024
_LONG = 2 ** 63 - 1


def integer_vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(ids, floor(SCALE * x))`` of the usable rows of ``(id, vector)``, by vector
    length, whole numbers as doubles. Rows with a null id, a null vector, or a null or
    non-finite component are left out."""
    ids = batch.column(0)
    lists = batch.column(1)
    usable = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    for length in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == length))
        for first in range(0, len(rows), CHUNK):
            part = rows[first:first + CHUNK]
            vectors = flat[offsets[part][:, None] + np.arange(length)]
            fine = np.isfinite(vectors * SCALE).all(axis=1)
            yield numbers[part[fine]], np.floor(vectors[fine] * SCALE)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; what a long can't hold is its nearest end."""
    most = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * queries.shape[1]
    if most < 2 ** 53:
        return (queries @ candidates.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(queries) @ exact(candidates).T, -_LONG - 1, _LONG).astype(np.int64)


@dataclass
class Block:
    """Queries of a round, numbered from 0, by length."""
    ids: np.ndarray
    own: np.ndarray  # each query's score with itself
    groups: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> (query numbers, vectors)


def _blocks(queries: DataFrame) -> Iterator[Block]:
    """The query rows in blocks, a bounded number on the driver at a time."""
    def build(rows: list) -> Block:
        groups: dict[int, list[int]] = {}
        own = np.zeros(len(rows), dtype=np.int64)
        for i, (_, v) in enumerate(rows):
            groups.setdefault(len(v), []).append(i)
            vector = np.array([v], dtype=np.float64).reshape(1, len(v))
            own[i] = scores(vector, vector)[0, 0]
        return Block(np.array([i for i, _ in rows], dtype=np.int64), own,
                     {n: (np.array(at), np.array([rows[i][1] for i in at], dtype=np.float64).reshape(len(at), n))
                      for n, at in groups.items()})

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors in integer_vectors(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(list(vectors), pa.list_(pa.float64()))], ["id", "vector"])

    held = []
    for r in queries.mapInArrow(usable, "id long, vector array<double>").toLocalIterator():
        held.append((r["id"], r["vector"]))
        if len(held) == BLOCK_QUERIES:
            yield build(held)
            held = []
    if held:
        yield build(held)


def _hits(batches: Iterator[pa.RecordBatch], block: Block, lowest: np.ndarray, k: int
          ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(query numbers, candidate ids, scores)`` of a chunk of candidates that reach
    their query's ``lowest`` score and the query's k-th score in the chunk."""
    for batch in batches:
        for ids, vectors in integer_vectors(batch):
            if vectors.shape[1] not in block.groups or not len(ids):
                continue
            numbers, queries = block.groups[vectors.shape[1]]
            found = scores(queries, vectors)
            least = lowest[numbers]
            if len(ids) > k:
                least = np.maximum(least, np.partition(found, -k, axis=1)[:, -k])
            q, c = np.nonzero(found >= least[:, None])
            yield numbers[q], ids[c], found[q, c]


def _best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of the hits: high scores first, then small ids."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    place = np.arange(len(q))
    head = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    keep = place - np.maximum.accumulate(np.where(head, place, 0)) < k
    return q[keep], ids[keep], s[keep]


def _histogram(q: np.ndarray, bins: np.ndarray, counts: np.ndarray, k: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts summed by (query, bin), each query's down to the bin of its k-th row."""
    order = np.lexsort((-bins, q))
    q, bins, counts = q[order], bins[order], counts[order]
    first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (bins[1:] != bins[:-1])]) if len(q) else np.zeros(0, int)
    q, bins, counts = q[first], bins[first], np.add.reduceat(counts, first) if len(first) else counts
    total = np.cumsum(counts)
    head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    begun = np.repeat(np.r_[0, total][head], np.diff(np.r_[head, len(q)]))
    keep = total - begun - counts < k  # rows in higher bins
    return q[keep], bins[keep], counts[keep]


def _largest(candidates: DataFrame) -> float:
    """The largest absolute component of the usable candidates."""
    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.abs(vectors).max(initial=0) for batch in batches for _, vectors in integer_vectors(batch)]
        yield pa.RecordBatch.from_pydict({"most": pa.array([max(found, default=0)], pa.float64())})
    return candidates.mapInArrow(most, "most double").agg(F.max("most")).first()[0] or 0.0


def _select(candidates: DataFrame, block: Block, k: int, largest: float) -> np.ndarray:
    """Each query's k-th highest score, or a lower bound of its scores if it has fewer
    candidates."""
    spark = candidates.sparkSession
    bound = np.zeros(len(block.ids))
    for numbers, queries in block.groups.values():
        bound[numbers] = np.abs(queries).sum(axis=1) * largest
    low = [-int(x * (1 + 1e-9)) - 1 if x < 2 ** 62 else -_LONG - 1 for x in bound]  # no score is lower
    width = 1
    while width * BINS < 2 * -min(low, default=0) + 1:
        width *= BINS
    while True:
        shipped = spark.sparkContext.broadcast((block, np.array(low, dtype=np.int64), width))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, low, width = shipped.value
            q = bins = counts = np.zeros(0, dtype=np.int64)
            for numbers, _, s in _hits(batches, block, low, k):
                # differences of longs as unsigned numbers: they may exceed a long
                at = (s.view(np.uint64) - low[numbers].view(np.uint64)) // np.uint64(width)
                at = np.minimum(at, np.uint64(BINS - 1)).astype(np.int64)
                q, bins, counts = _histogram(np.r_[q, numbers], np.r_[bins, at],
                                             np.r_[counts, np.ones(len(at), dtype=np.int64)], k)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(bins), pa.array(counts)], ["q", "bin", "n"])

        counted = candidates.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(
            F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        reached = (counted.withColumn("above", above).where(F.col("above") >= k)
                          .groupBy("q").agg(F.max("bin").alias("bin")).collect())  # one row a query of the block
        for r in reached:
            low[r["q"]] += r["bin"] * width
        if width == 1 or not reached:
            return np.array(low, dtype=np.int64)
        width //= BINS


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest integer inner products of
    every row of ``queries (id, vector)`` among the rows of ``candidates``.

    Vectors are scaled to whole numbers first; vectors of another length aren't
    comparable. One candidate row with the query's id and its score with itself is the
    query's own and takes no part; other rows with that id do. Equal scores go to the
    smaller id, then to either of rows equal in both. Repeated query rows get a result
    each. Null ids, null vectors and vectors with null or non-finite components
    take no part; empty tables give an empty result.
    """
    spark = candidates.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    candidates = candidates.select(F.col(candidates.columns[0]).cast("long").alias("id"),
                                   F.col(candidates.columns[1]).cast("array<double>").alias("vector"))
    queries = queries.select(F.col(queries.columns[0]).cast("long").alias("id"),
                             F.col(queries.columns[1]).cast("array<double>").alias("vector"))
    largest, found = _largest(candidates), None
    uri = shared_uri(spark, "top-k")
    for number, block in enumerate(_blocks(queries)):
        if found is not None:  # several blocks: each is written, so that plans don't pile up
            found.write.mode("append").parquet(uri)
        # one more than k: a query's own row goes afterwards
        shipped = spark.sparkContext.broadcast((block, _select(candidates, block, k + 1, largest)))

        def reach(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            block, lowest = shipped.value
            q = ids = s = np.zeros(0, dtype=np.int64)
            for numbers, found, score in _hits(batches, block, lowest, k + 1):
                q, ids, s = _best(np.r_[q, numbers], np.r_[ids, found], np.r_[s, score], k + 1)
            own = (ids == block.ids[q]) & (s == block.own[q])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(block.ids[q]), pa.array(ids), pa.array(s),
                                              pa.array(own.astype(np.int32))],
                                             ["q", "query_id", "vec_id", "score", "own"])

        best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        met = F.sum("own").over(best.rowsBetween(Window.unboundedPreceding, 0))
        found = (candidates.mapInArrow(reach, "q long, query_id long, vec_id long, score long, own int")
                 .withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
                 .withColumn("met", met).where((F.col("own") == 0) | (F.col("met") > 1))
                 .withColumn("rank", F.col("place") - F.least("met", F.lit(1)).cast("int")).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))
    if found is None:
        return spark.createDataFrame([], schema)
    return found if number == 0 else found.unionByName(spark.read.schema(schema).parquet(uri))


def is_query(vec_id: Column) -> Column:
    return vec_id % QUERY_STEP == 0


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every 50th one."""
    prepare(spark)
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.where(is_query(F.col("vec_id"))), vectors)
