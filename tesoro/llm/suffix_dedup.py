"""Removal of repeated byte strings with a distributed suffix array.

A string of ``LENGTH`` bytes is a window. The text that the difference-cover sort works
on is made small first, without losing a repeat:

* Of equal texts one stands for all; texts with an equal are removed whole.
* Each window has an anchor: the leftmost of its inner strings of half its length with
  the smallest hash. Equal windows have equal anchors at equal places, so a window whose
  anchor string is there once in the corpus does not repeat. What is left of a text is
  runs of repeated anchors, strings over the symbols (anchor string, distance to the
  next).

The difference-cover sort brings all suffixes of these strings in order (as far as the
compared symbols go), and adjacent suffixes are compared: a common prefix of symbols is a
common string of bytes, and decides the windows inside it. Only windows that the symbols
leave open, at the ends of repeats, are compared with the others of the same anchor
string, by fingerprint.

Files of the shared folder, mapped by the workers, hold the sets and the decisions; no
text is shuffled.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesoro.llm.common import map_file, mounted_path, prepare, read, shared_uri, steps, store, values, write_file
from tesoro.llm.difference_cover import BASE_SYMBOLS, suffix_order
from tesoro.llm.hash_arrays import HashSet, bits_for, count_blocks, top_part, write_set

LENGTH = 200
# Text bytes whose hashes one task merges.
PART_BYTES = 32 << 20
# Windows of a text that are looked at a time; positions in them take POSITION_BITS bits.
CHUNK = 1 << 18
POSITION_BITS = np.uint64(20)
# Symbols of a suffix that are compared with its neighbour's; a longer common prefix is cut.
PREFIX = 8
# Bits of an anchor's place in its partition, and of a distance in a symbol.
NUMBER_BITS = 32
GAP_BITS = 7
NO_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK + 4096, np.uint64(_BASE))], dtype=np.uint64)
_INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK + 4096, np.uint64(pow(_BASE, -1, 1 << 64)))], dtype=np.uint64)


def _sums(data: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWERS[:len(data)]], dtype=np.uint64)


def _grams(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position: a polynomial, then mixed."""
    x = (sums[size:] - sums[:-size]) * _INVERSE[:len(sums) - size]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    blocks = np.r_[x, np.full(-len(x) % width, np.iinfo(np.uint64).max, dtype=np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def _chunks(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(first, data)``: the windows that begin at ``first`` up to CHUNK further lie in
    ``data``, which begins there."""
    data = np.frombuffer(text, dtype=np.uint8)
    for first in range(0, len(data) - length + 1, CHUNK):
        yield first, data[first:first + CHUNK + length - 1]


@dataclass
class Anchors:
    """Anchors of a text in order: place, first and last window of each, string hash."""
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hash: np.ndarray


def anchors(text: bytes, length: int = LENGTH) -> Anchors:
    """A text shorter than a window has none."""
    size = length // 2
    parts: list[tuple[np.ndarray, ...]] = []
    for begin, data in _chunks(text, length):
        grams = _grams(_sums(data), size)
        places = np.arange(len(grams), dtype=np.uint64)
        least = _sliding_min((grams >> POSITION_BITS << POSITION_BITS) | places, length - size + 1)
        head = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        at = (least[head] & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)
        # anchors have small hashes: mixed anew, so that they spread over all parts
        hashes = grams[at] * np.uint64(0xD6E8FEB86659FD93)
        found = [at + begin, head + begin, np.r_[head[1:], len(least)] - 1 + begin, hashes ^ (hashes >> np.uint64(32))]
        if parts and parts[-1][0][-1] == found[0][0]:  # one anchor's windows in two chunks
            parts[-1][2][-1] = found[2][0]
            found = [x[1:] for x in found]
        if len(found[0]):
            parts.append(tuple(found))
    if not parts:
        empty = np.zeros(0, dtype=np.int64)
        return Anchors(empty, empty, empty, np.zeros(0, dtype=np.uint64))
    return Anchors(*(np.concatenate(x) for x in zip(*parts)))


def window_hashes(text: bytes, first: np.ndarray, last: np.ndarray, length: int = LENGTH
                  ) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, fingerprints)`` of the windows in the ranges [first, last]."""
    wanted = np.zeros(max(0, len(text) - length + 1) + 1, dtype=np.int64)
    np.add.at(wanted, first, 1)
    np.add.at(wanted, last + 1, -1)
    wanted = np.cumsum(wanted)[:-1] > 0
    starts, hashes = [], []
    for begin, data in _chunks(text, length):
        at = np.flatnonzero(wanted[begin:begin + CHUNK])
        if len(at):
            starts.append(at + begin)
            hashes.append(_grams(_sums(data), length)[at])
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def text_keys(texts: list[bytes | None]) -> np.ndarray:
    """128-bit keys of texts as two columns."""
    digests = [xxhash.xxh3_128_intdigest(t or b"") for t in texts]
    return np.array([(d >> 64, d & (1 << 64) - 1) for d in digests], dtype=np.uint64).reshape(-1, 2)


class Keyed:
    """Packed values by text key in files ``name-PART``: key count, keys sorted, offsets,
    values as 64-bit numbers."""

    def __init__(self, folder: str, name: str, bits: int):
        self.folder, self.name, self.bits = folder, name, bits
        self._open: dict[int, tuple] = {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def _part(self, part: int) -> tuple:
        if part not in self._open:
            data = map_file(os.path.join(self.folder, f"{self.name}-{part}"), "<u8")
            data = data if len(data) else np.zeros(2, np.uint64)
            n = int(data[0])
            self._open[part] = (data[1:n + 1], data[n + 1:2 * n + 1], data[2 * n + 1:3 * n + 2], data[3 * n + 2:])
        return self._open[part]

    def find(self, keys: np.ndarray) -> list[np.ndarray | None]:
        """The value of each key; None for those without one."""
        out: list[np.ndarray | None] = []
        parts = top_part(self.bits)(keys[:, 0])
        for part, (k1, k2) in zip(parts.tolist(), keys):
            high, low, offsets, held = self._part(part)
            at = int(np.searchsorted(high, k1))
            while at < len(high) and high[at] == k1 and low[at] != k2:
                at += 1
            hit = at < len(high) and high[at] == k1
            out.append(np.asarray(held[int(offsets[at]):int(offsets[at + 1])]).view(np.int64) if hit else None)
        return out


def write_keyed(rows: DataFrame, folder: str, name: str, bits: int) -> Keyed:
    """Write ``(k1, k2, value)`` rows, distinct in their key, as signed longs and binary."""
    def write(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        keys = np.array([table["k1"].to_numpy(), table["k2"].to_numpy()]).view(np.uint64)
        order = np.lexsort((keys[1], keys[0]))
        held = [table["value"][int(i)].as_py() for i in order]
        offsets = np.cumsum([0, *(len(v) // 8 for v in held)]).astype("<u8")
        write_file(os.path.join(folder, f"{name}-{part}"), np.array([len(order)], dtype="<u8").tobytes(),
                   keys[0][order].astype("<u8").tobytes(), keys[1][order].astype("<u8").tobytes(),
                   offsets.tobytes(), *held)
        return pa.table({"part": pa.array([part], pa.int32())})

    part = F.shiftrightunsigned("k1", 64 - bits).cast("int") if bits else F.lit(0)
    rows.withColumn("part", part).groupBy("part").applyInArrow(write, "part int").count()
    return Keyed(folder, name, bits)


class _Step:
    """The rows of a step, and the anchors of those whose text stands for its equals."""

    def __init__(self, batch: pa.RecordBatch, copies: Keyed | None, length: int, scan_copies: bool = False):
        self.ids, self.texts = values(batch, "id"), [t or b"" for t in values(batch, "text")]
        self.keys = text_keys(self.texts)
        found = copies.find(self.keys) if copies else [None] * len(self.texts)
        self.copy = [f is not None for f in found]
        self.rows = [i for i, f in enumerate(found) if len(self.texts[i]) >= length
                     and (f is None or not scan_copies and int(f[0]) == (NO_ID if self.ids[i] is None else self.ids[i]))]
        self.anchors = [anchors(self.texts[i], length) for i in self.rows]

    def marked(self, hashes: HashSet) -> list[np.ndarray]:
        """For each scanned row, which of its anchors have a string of the set."""
        if not self.anchors:
            return []
        sizes = [len(a.hash) for a in self.anchors]
        return np.split(hashes.has(np.concatenate([a.hash for a in self.anchors])), np.cumsum(sizes)[:-1])


def _text_rows(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _find_copies(texts: DataFrame, folder: str, bits: int, length: int) -> Keyed:
    """Texts that are there more than once and hold a window, with the id of the row
    that stands for them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            held = values(step, "text")
            keys = text_keys(held).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0]), pa.array(keys[:, 1]), step.column(0)], ["k1", "k2", "id"]
            ).filter(pa.array([len(t) >= length for t in held], pa.bool_()))

    same = texts.mapInArrow(run, "k1 long, k2 long, id long").groupBy("k1", "k2").agg(
        F.count("*").alias("n"), F.min(F.coalesce("id", F.lit(NO_ID))).alias("id")).where("n > 1")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2).to_numpy().astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([i.tobytes() for i in ids], pa.binary())], ["k1", "k2", "value"])
    return write_keyed(same.select("k1", "k2", "id").mapInArrow(pack, "k1 long, k2 long, value binary"),
                       folder, "copies", bits)


class AnchorFiles:
    """The strings over repeated anchors: files ``symbols-PART`` (anchor string hashes)
    and ``gaps-PART`` (distances, 0 at the end of a run), one of each for each partition
    of the scan. An anchor's number is the partition and the place in its file."""

    def __init__(self, folder: str):
        self.folder = folder
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def part(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        if part not in self._open:
            self._open[part] = tuple(map_file(os.path.join(self.folder, f"{name}-{part}"), kind)
                                     for name, kind in (("symbols", "<u8"), ("gaps", "<u2")))
        return self._open[part]

    def prefixes(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next PREFIX hashes and distances of each anchor; 0 beyond a file's end."""
        hashes = np.zeros((len(numbers), PREFIX), dtype=np.uint64)
        gaps = np.zeros((len(numbers), PREFIX), dtype=np.int64)
        parts = numbers >> NUMBER_BITS
        for p in np.unique(parts):
            rows = np.flatnonzero(parts == p)
            held, distances = self.part(int(p))
            at = (numbers[rows] & ((1 << NUMBER_BITS) - 1))[:, None] + np.arange(PREFIX)
            inside = at < len(held)
            at = np.minimum(at, len(held) - 1)
            hashes[rows] = np.where(inside, held[at], 0)
            gaps[rows] = np.where(inside, distances[at], 0)
        return hashes, gaps


_TEXT = "k1 long, k2 long, first_number long, hash binary, gap binary, at binary, first binary, last binary, alone binary"


def _anchor_texts(texts: DataFrame, copies: Keyed, repeated: HashSet, folder: str, length: int) -> DataFrame:
    """One row for each text with repeated anchors: packed columns of those in runs that
    can hold a window, numbered on from ``first_number``, and the hashes of the others
    (``alone``). Writes the files of ``AnchorFiles``."""
    shipped = texts.sparkSession.sparkContext.broadcast((copies, repeated))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, repeated = shipped.value
        part = TaskContext.get().partitionId()
        symbols: list[bytes] = []
        distances: list[bytes] = []
        number = part << NUMBER_BITS
        for batch in steps(batches, "text"):
            step = _Step(batch, copies, length)
            rows = []
            for i, found, mark in zip(step.rows, step.anchors, step.marked(repeated)):
                if not mark.any():
                    continue
                edge = np.flatnonzero(np.diff(np.r_[False, mark, False].astype(np.int8)))
                begin, end = edge[::2], edge[1::2]
                long = found.at[end - 1] + length // 2 - found.at[begin] >= length
                inside = np.zeros(len(mark) + 1, dtype=np.int64)
                inside[begin[long]] += 1
                inside[end[long]] -= 1
                inside = np.cumsum(inside)[:-1] > 0
                gap = np.r_[np.diff(found.at), 0]
                gap[end - 1] = 0
                packed = [found.hash[inside].astype("<u8").tobytes(), gap[inside].astype("<u2").tobytes(),
                          *(x[inside].astype("<u4").tobytes() for x in (found.at, found.first, found.last)),
                          found.hash[mark & ~inside].astype("<u8").tobytes()]
                rows.append((*step.keys[i].view(np.int64).tolist(), number, *packed))
                symbols.append(packed[0])
                distances.append(packed[1])
                number += int(inside.sum())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        write_file(os.path.join(folder, f"symbols-{part}"), *symbols)
        write_file(os.path.join(folder, f"gaps-{part}"), *distances)

    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in _TEXT.split(", "))])
    return store(texts.mapInArrow(run, _TEXT), "anchor-texts")


def _symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, hashes and distances of the anchors of ``(first_number, hash, gap)`` rows."""
    hashes = [np.frombuffer(x, "<u8") for x in values(batch, "hash")]
    numbers = [np.arange(f, f + len(h)) for f, h in zip(values(batch, "first_number"), hashes)]
    gaps = np.frombuffer(b"".join(values(batch, "gap")), "<u2").astype(np.int64)
    return np.concatenate(numbers), np.concatenate(hashes), gaps


def _triples(texts: DataFrame) -> DataFrame:
    """The strings as ``triples_of`` would make them: a run's number is its first
    anchor's, a symbol orders by the anchor string's hash and then the distance. Of the
    hash 56 bits are in it: two that share them merely stand together in the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number, hashes, gaps = _symbols(batch)
            if not len(number):
                continue
            symbol = ((hashes >> np.uint64(8) << np.uint64(GAP_BITS)).astype(np.int64)
                      | np.minimum(gaps, (1 << GAP_BITS) - 2)) + 1
            last = gaps == 0
            place = np.arange(len(number))
            head = np.maximum.accumulate(np.where(np.r_[True, last[:-1]], place, 0))
            end = np.minimum.accumulate(np.where(last, place, len(place))[::-1])[::-1]  # of the run
            after = [np.where(place + i <= end, symbol[np.minimum(place + i, len(place) - 1)], 0) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number - (place - head)), pa.array((place - head).astype(np.int32)), pa.array(symbol),
                 *map(pa.array, after)], ["sid", "pos", "s0", "s1", "s2"])

    return texts.select("first_number", "hash", "gap").mapInArrow(run, "sid long, pos int, s0 long, s1 long, s2 long")


def _common(hashes: np.ndarray, gaps: np.ndarray, size: int) -> np.ndarray:
    """Bytes that each suffix but the last has in common with the one after it, as far
    as the symbols tell: up to the end of the last equal anchor string."""
    common = np.zeros(len(hashes) - 1, dtype=np.int64)
    offset = np.zeros(len(hashes) - 1, dtype=np.int64)
    alive = np.ones(len(hashes) - 1, dtype=bool)
    for j in range(PREFIX):
        alive &= (hashes[:-1, j] == hashes[1:, j]) & (hashes[:-1, j] != 0)
        common = np.where(alive, offset + size, common)
        offset = offset + gaps[:-1, j]
        alive &= (gaps[:-1, j] == gaps[1:, j]) & (gaps[:-1, j] != 0)
    return common


def _compare(ordered: DataFrame, files: AnchorFiles, length: int) -> DataFrame:
    """``(part, place, common)`` of the anchors from which the text has a window in common
    with a neighbour in the suffix order: the bytes in common. Neighbours in two tasks of
    the sort are not compared: their windows stay open."""
    shipped = ordered.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = shipped.value
        held, before = np.zeros(0, dtype=np.int64), 0
        for batch in batches:
            numbers = np.r_[held, batch.column(0).to_numpy() + batch.column(1).to_numpy()]
            if not len(numbers):
                continue
            after = np.r_[_common(*files.prefixes(numbers), length // 2), 0]
            best = np.maximum(after, np.r_[before, after[:-1]])
            before, held = int(after[-2]) if len(after) > 1 else before, numbers[-1:]
            yield emit(numbers[:-1], best[:-1])
        yield emit(held, np.array([before] * len(held), dtype=np.int64))

    def emit(numbers: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        sure = best >= length
        return pa.RecordBatch.from_arrays(
            [pa.array((numbers[sure] >> NUMBER_BITS).astype(np.int32)), pa.array(numbers[sure] & ((1 << NUMBER_BITS) - 1)),
             pa.array(best[sure].astype(np.int32))], ["part", "place", "common"])

    return ordered.mapInArrow(run, "part int, place long, common int")


def _write_common(found: DataFrame, folder: str) -> None:
    """Files ``common-PART``: the common bytes of each anchor of ``symbols-PART``."""
    def write(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        size = os.path.getsize(os.path.join(folder, f"gaps-{part}")) // 2
        common = np.zeros(size, dtype="<u4")
        common[table["place"].to_numpy()] = table["common"].to_numpy()
        write_file(os.path.join(folder, f"common-{part}"), common.tobytes())
        return pa.table({"part": pa.array([part], pa.int32())})
    found.groupBy("part").applyInArrow(write, "part int").count()


def _union(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges [first, last]; neighbouring ones are joined."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order]) if len(last) else last
    head = np.r_[True, first[1:] > last[:-1] + 1] if len(first) else np.zeros(0, bool)
    return first[head], last[np.r_[np.flatnonzero(head)[1:] - 1, len(last) - 1]] if len(first) else last


def _decide(texts: DataFrame, folder: str, length: int) -> DataFrame:
    """``(k1, k2, value, open)`` of each text of ``_anchor_texts``: the ranges of windows
    that the suffix order decides, and the anchor strings with windows left open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            sure_, open_ = [], []
            for r in batch.to_pylist():
                hashes = np.frombuffer(r["hash"], "<u8")
                at, first, last = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("at", "first", "last"))
                part, place = r["first_number"] >> NUMBER_BITS, r["first_number"] & ((1 << NUMBER_BITS) - 1)
                if part not in held:
                    held[part] = map_file(os.path.join(folder, f"common-{part}"), "<u4")
                common = np.zeros(len(at), dtype=np.int64)
                known = held[part][place:place + len(at)]
                common[:len(known)] = known
                sure = common >= length
                low, high = _union(at[sure], (at + common - length)[sure])
                inside = np.searchsorted(low, first, side="right") - 1
                settled = (inside >= 0) & (last <= (high[inside] if len(high) else -1))
                sure_.append(np.c_[low, high].astype("<i8").tobytes())
                open_.append(np.unique(np.r_[hashes[~settled], np.frombuffer(r["alone"], "<u8")]).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sure_, pa.binary()),
                                              pa.array(open_, pa.binary())], ["k1", "k2", "value", "open"])
    return store(texts.mapInArrow(run, "k1 long, k2 long, value binary, open binary"), "decided-windows")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", length: int = LENGTH,
                   keep_text: bool = False, base: int = BASE_SYMBOLS) -> DataFrame:
    """One row per row of ``docs``: the id as ``doc_id``, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` and ``spans`` (byte ranges [first, last) that windows
    starting in two places cover), and with ``keep_text`` the kept bytes as ``kept``.

    Null texts are empty. Repeated rows are equal texts, which remove each other. Texts
    shorter than a window keep all. Ids may be null or repeat. An empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = _text_rows(docs, id_col)
    folder = mounted_path(shared_uri(spark, "suffix-dedup"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits_for(1 + size // PART_BYTES)
    copies = _find_copies(texts, folder, bits, length)
    held = context.broadcast(copies)

    def anchor_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in steps([batch], "text"):
            found = _Step(part, held.value, length).anchors
            if found:
                yield np.concatenate([a.hash for a in found])
    repeated = write_set(count_blocks(texts, anchor_hashes, bits), folder, "anchors", bits, at_least=2)

    anchored = _anchor_texts(texts, copies, repeated, folder, length)
    n = anchored.agg(F.sum(F.octet_length("gap") / 2)).first()[0] or 0
    ordered = suffix_order(_triples(anchored), int(n), PREFIX, base)
    _write_common(_compare(ordered, AnchorFiles(folder), length), folder)
    decided = _decide(anchored, folder, length)
    sure = write_keyed(decided.where("octet_length(value) > 0").select("k1", "k2", "value"), folder, "sure", bits)

    def open_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.frombuffer(b"".join(values(batch, "open")), dtype="<u8")
    unsettled = write_set(count_blocks(decided.select("open"), open_hashes, bits), folder, "open", bits)
    shipped = context.broadcast((copies, unsettled, sure))

    def window_counts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        copies, unsettled, _ = shipped.value
        for part in steps([batch], "text"):
            step = _Step(part, copies, length)
            for i, found, mark in zip(step.rows, step.anchors, step.marked(unsettled)):
                if mark.any():
                    yield window_hashes(step.texts[i], found.first[mark], found.last[mark], length)[1]
    again = write_set(count_blocks(texts, window_counts, bits), folder, "windows", bits, at_least=2)
    last = context.broadcast(again)
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, unsettled, sure = shipped.value
        for part in steps(batches, "text"):
            step = _Step(part, copies, length, scan_copies=True)
            ranges: list[tuple[np.ndarray, np.ndarray]] = [
                (np.zeros(1, np.int64), np.full(1, len(t) - length)) if c else (np.zeros(0, np.int64),) * 2
                for t, c in zip(step.texts, step.copy)]
            decided = sure.find(step.keys[step.rows]) if step.rows else []
            open_: list[tuple[int, np.ndarray, np.ndarray]] = []
            for i, found, mark, known in zip(step.rows, step.anchors, step.marked(unsettled), decided):
                if known is not None:
                    pairs = known.reshape(-1, 2)
                    ranges[i] = (pairs[:, 0], pairs[:, 1])
                if mark.any():
                    open_.append((i, *window_hashes(step.texts[i], found.first[mark], found.last[mark], length)))
            if open_:
                hits = np.split(last.value.has(np.concatenate([h for _, _, h in open_])),
                                np.cumsum([len(h) for _, _, h in open_])[:-1])
                for (i, starts, _), hit in zip(open_, hits):
                    ranges[i] = (np.r_[ranges[i][0], starts[hit]], np.r_[ranges[i][1], starts[hit]])
            out: list[list] = [[] for _ in range(6)]
            for text, (first, end) in zip(step.texts, ranges):
                low, high = _union(first, end + length - 1)
                spans = list(zip(low.tolist(), (high + 1).tolist()))
                kept = b"".join(text[a:b] for a, b in zip([0, *(x for _, x in spans)], [*(x for x, _ in spans), len(text)]))
                for column, value in zip(out, (len(text), len(text) - len(kept), len(spans),
                                               hashlib.sha256(kept).hexdigest(),
                                               [{"first": a, "last": b} for a, b in spans], kept)):
                    column.append(value)
            arrays = [part.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()),
                      pa.array(out[4], span), pa.array(out[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays[:6 + keep_text], kinds[:6 + keep_text])

    kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
              "spans array<struct<first:long,last:long>>")
    return texts.mapInArrow(cut, schema + ", kept binary" * keep_text)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a 200-byte string that starts in two places."""
    prepare(spark)
    return repeated_spans(read(spark, sf_dir, "documents"))
