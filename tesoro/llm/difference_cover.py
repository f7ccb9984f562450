"""Distributed suffix sorting by the difference cover modulo 3.

Positions 1 and 2 modulo 3 of every string are sampled. Their triples of symbols are
sorted and named by their order; the names form strings of two thirds of the size, which
are sorted by recursion. A position 0 modulo 3 is then ordered by its symbol and the
rank of the sampled position after it, and merged: against positions 1 modulo 3 by
(symbol, rank one further), against 2 modulo 3 by (two symbols, rank two further).

Every sort is a range-partitioned Spark sort whose keys end with the position, so equal
triples of any number are split over tasks; what spans two tasks is joined up from one
row a task. A rank is an increasing 64-bit number, not a dense one.

Where only the first symbols of suffixes are to be compared, the recursion ends as soon
as names cover them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesoro.llm.common import store
from tesoro.llm.fm_index import suffix_array

# Symbols that the recursion leaves to one task.
BASE_SYMBOLS = 200_000
# A name is the sort's partition and the place of the first equal triple in it.
PLACE_BITS = 40


def triples_of(strings: DataFrame) -> DataFrame:
    """``(sid, pos, s0, s1, s2)``: each symbol of the strings ``(sid, pos, sym)`` and the
    two after it, 0 beyond the end."""
    along = Window.partitionBy("sid").orderBy("pos")
    return strings.select("sid", F.col("pos").cast("int").alias("pos"), F.col("sym").alias("s0"), *[
        F.coalesce(F.lead("sym", i).over(along), F.lit(0).cast("long")).alias(f"s{i}") for i in (1, 2)])


_NAMED = "sid long, pos int, part int, place long, s0 long, s1 long, s2 long, n long"


def _number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of equal triples in a sorted partition, and at its end two rows (sid -1)
    with its first and last triple, the last one's place, and its numbers of rows and of
    distinct triples."""
    part, row, place, distinct = TaskContext.get().partitionId(), 0, 0, 0
    first = last = None

    def rows(sid, pos, places, key, n) -> pa.RecordBatch:
        size = len(sid)
        keys = [pa.nulls(size, pa.int64())] * 3 if key is None else [pa.array(k, pa.int64()) for k in key]
        return pa.RecordBatch.from_arrays(
            [pa.array(sid, pa.int64()), pa.array(pos, pa.int32()), pa.array([part] * size, pa.int32()),
             pa.array(places, pa.int64()), *keys, pa.array(n, pa.int64()) if n is not None else pa.nulls(size, pa.int64())],
            ["sid", "pos", "part", "place", "s0", "s1", "s2", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.array([batch.column(i).to_numpy() for i in (2, 3, 4)])
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        new[0] = last is None or (key[:, 0] != last).any()
        here = np.arange(row + 1, row + 1 + batch.num_rows)
        places = np.maximum(np.maximum.accumulate(np.where(new, here, 0)), place)
        row, place, distinct, last = row + batch.num_rows, int(places[-1]), distinct + int(new.sum()), key[:, -1]
        first = key[:, 0] if first is None else first
        yield rows(batch.column(0), batch.column(1), places, None, None)
    if first is not None:
        yield rows([-1, -1], [0, 1], [1, place], np.array([first, last]).T, [row, distinct])


def _name(sample: DataFrame) -> tuple[DataFrame, bool]:
    """``(sid, pos, name)`` of the triples in their order, equal ones with one name; and
    whether all differ."""
    keys = ["s0", "s1", "s2", "sid", "pos"]
    numbered = store(sample.select("sid", "pos", "s0", "s1", "s2").repartitionByRange(*keys)
                     .sortWithinPartitions(*keys).mapInArrow(_number_runs, _NAMED), "names")
    ends: dict[int, dict[int, tuple]] = {}  # two rows for each partition of the sort
    for r in numbered.where("sid = -1").collect():
        ends.setdefault(r["part"], {})[r["pos"]] = ((r["s0"], r["s1"], r["s2"]), r["place"], r["n"])
    moved, all_rows, distinct, before, name = [], 0, 0, None, 0
    for part in sorted(ends):
        (first, _, rows), (last, place, kinds) = ends[part][0], ends[part][1]
        joined = first == before
        all_rows, distinct = all_rows + rows, distinct + kinds - joined
        if joined:  # the first triple goes on from the partition before
            moved.append((part, name))
        if not joined or kinds > 1:
            name = (part << PLACE_BITS) + place
        before = last
    own = F.shiftleft(F.col("part").cast("long"), PLACE_BITS) + F.col("place")
    named = numbered.where("sid >= 0")
    if moved:
        fix = F.broadcast(sample.sparkSession.createDataFrame(moved, "part int, moved long"))
        named = named.join(fix, "part", "left").withColumn(
            "name", F.when(F.col("place") == 1, F.coalesce("moved", own)).otherwise(own))
    else:
        named = named.withColumn("name", own)
    return named.select("sid", "pos", "name"), all_rows == distinct


def _solve(strings: DataFrame) -> DataFrame:
    """Ranks of a bounded number of symbols, in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(i).to_numpy() for i in range(3)] for b in batches]
        if not held:
            return
        sid, pos, sym = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((pos, sid))
        sid, pos, sym = sid[order], pos[order], sym[order]
        text = np.unique(sym, return_inverse=True)[1] + 1
        last = np.flatnonzero(np.r_[sid[1:] != sid[:-1], True]) if len(sid) else np.zeros(0, np.int64)
        closed = np.insert(text, last + 1, 0)  # an end below all symbols after each string
        at = np.delete(np.arange(len(closed)), last + 1 + np.arange(len(last)))
        rank = np.empty(len(closed), dtype=np.int64)
        rank[suffix_array(closed)] = np.arange(1, len(closed) + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sid, pa.int64()), pa.array(pos, pa.int32()), pa.array(rank[at], pa.int64())],
            ["sid", "pos", "rank"])

    return strings.select("sid", "pos", "sym").repartition(1).mapInArrow(run, "sid long, pos int, rank long")


def _places_of_unsampled(triples: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(sid, pos, after, s0, r1)`` of the positions 0 modulo 3: the highest rank of the
    sampled suffixes below, the symbol, and the rank of the next position."""
    nothing = F.lit(None).cast("long")
    known = (triples.select("sid", "pos", "s0", "s1", nothing.alias("rank"))
             .unionByName(ranks.select("sid", "pos", nothing.alias("s0"), nothing.alias("s1"), "rank"))
             .repartition("sid").groupBy("sid", "pos").agg(
                 F.max("s0").alias("s0"), F.max("s1").alias("s1"), F.max("rank").alias("rank")))
    along = Window.partitionBy("sid").orderBy("pos")
    ranked = known.select("sid", "pos", "s0", "s1", "rank", *[
        F.coalesce(F.lead("rank", i).over(along), F.lit(0).cast("long")).alias(f"r{i}") for i in (1, 2)])
    zero, mod = F.lit(0).cast("long"), F.col("pos") % 3
    against_1 = F.struct(F.lit(1).alias("kind"), F.col("s0").alias("k0"), F.col("r1").alias("k1"), zero.alias("k2"))
    against_2 = F.struct(F.lit(2).alias("kind"), F.col("s0").alias("k0"), F.col("s1").alias("k1"), F.col("r2").alias("k2"))
    keys = F.when(mod == 0, F.array(against_1, against_2)).when(mod == 1, F.array(against_1)).otherwise(F.array(against_2))
    rows = ranked.select("sid", "pos", F.coalesce("rank", zero).alias("rank"), F.explode(keys).alias("k")).select(
        "sid", "pos", "rank", "k.*")
    order = ["kind", "k0", "k1", "k2", "sid", "pos"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The highest rank so far in the partition and kind, for rows without a rank; a
        last row (sid -1) for each kind has the highest of all."""
        part, high = TaskContext.get().partitionId(), {}
        for batch in batches:
            rank, kind = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            highs = np.empty(len(rank), dtype=np.int64)
            for k in np.unique(kind):
                at = kind == k
                highs[at] = np.maximum(np.maximum.accumulate(rank[at]), high.get(int(k), 0))
                high[int(k)] = int(highs[at][-1])
            table = pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 3, 4, 5)), pa.array([part] * len(rank), pa.int32()),
                 pa.array(highs, pa.int64())], ["sid", "pos", "kind", "k0", "k1", "part", "high"])
            yield table.filter(pa.array(rank == 0))
        kinds = sorted(high)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1] * len(kinds), pa.int64()), pa.array([0] * len(kinds), pa.int32()), pa.array(kinds, pa.int32()),
             pa.array([0] * len(kinds), pa.int64()), pa.array([0] * len(kinds), pa.int64()),
             pa.array([part] * len(kinds), pa.int32()), pa.array([high[k] for k in kinds], pa.int64())],
            ["sid", "pos", "kind", "k0", "k1", "part", "high"])

    found = store(ordered.mapInArrow(below, "sid long, pos int, kind int, k0 long, k1 long, part int, high long"), "places")
    carried, highest = [], {}
    for r in sorted(found.where("sid = -1").collect(), key=lambda r: (r["kind"], r["part"])):
        carried.append((r["kind"], r["part"], highest.get(r["kind"], 0)))
        highest[r["kind"]] = max(highest.get(r["kind"], 0), r["high"])
    carry = F.broadcast(triples.sparkSession.createDataFrame(carried, "kind int, part int, carried long"))
    first = F.col("kind") == 1
    return found.where("sid >= 0").join(carry, ["kind", "part"]).groupBy("sid", "pos").agg(
        F.max(F.greatest("high", "carried")).alias("after"), F.max(F.when(first, F.col("k0"))).alias("s0"),
        F.max(F.when(first, F.col("k1"))).alias("r1"))


_ORDER = ["after", "kind", "s0", "r1", "sid", "pos"]


def _merge(triples: DataFrame, covered: int, prefix: int | None, base: int) -> DataFrame:
    """``(sid, pos)`` and the keys of ``_ORDER`` that order all suffixes. ``covered``
    symbols of the first strings are in one symbol of these."""
    named, distinct = _name(triples.where("pos % 3 <> 0"))
    if distinct or prefix is not None and 3 * covered >= prefix:
        ranks = named.withColumnRenamed("name", "rank")
    else:
        again = suffix_ranks(named.select(
            (F.col("sid") * 2 + F.col("pos") % 3 - 1).alias("sid"), F.expr("int(pos div 3)").alias("pos"),
            F.col("name").alias("sym")), base, prefix, 3 * covered)
        ranks = again.select(F.expr("shiftright(sid, 1)").alias("sid"),
                             (F.col("pos") * 3 + 1 + (F.col("sid") % 2).cast("int")).alias("pos"), "rank")
    zero = F.lit(0).cast("long")
    sampled = ranks.select("sid", "pos", F.col("rank").alias("after"), F.lit(0).alias("kind"), zero.alias("s0"),
                           zero.alias("r1"))
    others = _places_of_unsampled(triples, ranks).select("sid", "pos", "after", F.lit(1).alias("kind"), "s0", "r1")
    return sampled.unionByName(others)


def suffix_ranks(strings: DataFrame, base: int = BASE_SYMBOLS, prefix: int | None = None, covered: int = 1) -> DataFrame:
    """``(sid, pos, rank)`` of every position of the strings ``(sid, pos, sym)``:
    positions are 0, 1, ... in each string, symbols are 1 or more, ids are 0 or more.
    Ranks are distinct and ordered as the suffixes; a suffix that ends sorts before its
    continuations, and equal suffixes have neighbouring ranks. With ``prefix`` suffixes
    that agree in so many symbols may stand in any order."""
    strings = store(strings, "strings")
    n = strings.count()
    if n <= base:
        return _solve(strings)
    merged = _merge(triples_of(strings), covered, prefix, base)
    ordered = merged.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    return store(ordered.select("sid", "pos", (F.monotonically_increasing_id() + 1).alias("rank")), "ranks")


def suffix_order(triples: DataFrame, n: int, prefix: int | None = None, base: int = BASE_SYMBOLS) -> DataFrame:
    """``(sid, pos)`` of all suffixes of the ``n`` symbols of ``triples`` (as made by
    ``triples_of``), range-partitioned and sorted in their order. ``prefix`` is that of
    ``suffix_ranks``."""
    if n <= base:
        ranks = _solve(triples.withColumnRenamed("s0", "sym"))
        return ranks.repartitionByRange("rank").sortWithinPartitions("rank").select("sid", "pos")
    merged = _merge(triples, 1, prefix, base)
    return merged.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("sid", "pos")
