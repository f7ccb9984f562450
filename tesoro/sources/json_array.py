"""S1 for very large files: one JSON array read by many tasks.

Spark's text source splits a file at every ``}``, so any store that Spark reads will do and
a task reads only its own byte range. What a range begins with (inside a text? how deep?
which record?) depends on all before it, so the file is read twice:

1. every range is scanned once for both cases, begun inside a text or outside. It gives its
   change of depth and its commas and openings by relative depth: a small summary;
2. the summaries of a file, put together in order, tell what each range begins with. Records
   within a range are parsed there; only the pieces of records that cross its ends are
   shuffled, and joined by file and position.

The driver holds a summary (some 100 bytes) of each range, at most ``MAX_RANGES`` of them.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesoro.functions.storage import stored_in_turn

# Ranges of one reading: 25 TB of the default 128 MB.
MAX_RANGES = 200_000

_QUOTE, _ESCAPE, _OPEN, _CLOSE, _SPACE = b'"\\[} '
# What a byte outside texts does to the depth; NONE: nothing.
_NONE = 9
_STEP = np.full(256, _NONE, dtype=np.int8)
for _bytes, _change in ((b"[{", 1), (b"]}", -1), (b",", 0)):
    _STEP[list(_bytes)] = _change
_IS_STEP = _STEP != _NONE
# A file's content is a polynomial over its pieces' hashes, so that it is the same for any ranges.
_PRIME, _BASE = 2 ** 255 - 19, 0x9E3779B97F4A7C15F39CC0605CEDC835

_RANGE = "file string, start long, length long"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text up to each ``}``, in order within a range; the last piece of a file gets a
    ``}`` that the file has not."""
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "start"),
                                                          ("file_block_length", "length"))]
    return spark.read.option("lineSep", "}").text(path).select(
        *meta, F.concat("value", F.lit("}")).cast("binary").alias("value"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array]]:
    """``(range, pieces)`` of consecutive rows of one range; a range may come in several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts, lengths, pieces = batch.columns
        other = pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        for c in (starts, lengths):
            other |= np.diff(c.to_numpy()) != 0
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
        for first, end in zip(cuts, cuts[1:]):
            yield (files[first].as_py(), starts[first].as_py(), lengths[first].as_py()), pieces[first:end]


def _bytes_of(pieces: pa.Array) -> np.ndarray:
    """The pieces' bytes, one after the other, as Arrow holds them."""
    _, offsets, data = pieces.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(pieces.type) else np.int32)
    return np.frombuffer(data, np.uint8)[at[pieces.offset]:at[pieces.offset + len(pieces)]]


def _after_odd_quotes(data: np.ndarray) -> np.ndarray:
    """For each byte 1 if the quotes up to it are odd in number, not counting those that an
    odd run of backslashes precedes."""
    quotes = data == _QUOTE
    after = np.flatnonzero(quotes[1:] & (data[:-1] == _ESCAPE)) + 1
    if len(after):
        slashes = np.flatnonzero(data == _ESCAPE)
        first = slashes[np.r_[True, np.diff(slashes) > 1]]
        run = after - first[np.searchsorted(first, after, side="right") - 1]
        quotes[after[run % 2 == 1]] = False
    return np.add.accumulate(quotes, dtype=np.uint8) & 1


class Scan:
    """Depth and text state of a scan that begins with ``in_text`` at ``depth``; a step is
    a whole number of pieces, so no escape crosses two steps."""

    def __init__(self, in_text: bool, depth: int = 0):
        self.in_text, self.depth = in_text, depth

    def step(self, data: np.ndarray, at: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the brackets and commas outside texts, their change of depth, and the
        depth after each, of all such places ``at``."""
        at = at[odd[at] == self.in_text]
        change = _STEP[data[at]]
        after = self.depth + np.cumsum(change, dtype=np.int64)
        self.in_text = bool(odd[-1]) != self.in_text
        self.depth = int(after[-1]) if len(after) else self.depth
        return at, change, after


def _counts(depths: np.ndarray) -> dict[int, int]:
    if not len(depths):
        return {}
    low = int(depths.min())
    return {low + i: n for i, n in enumerate(np.bincount(depths - low).tolist()) if n}


class _Summary:
    def __init__(self, hashed: bool):
        self.scans = [Scan(False), Scan(True)]
        self.commas, self.opened = [Counter(), Counter()], [Counter(), Counter()]
        self.hashed, self.content, self.scale = hashed, 0, 1

    def add(self, pieces: pa.Array) -> None:
        data = _bytes_of(pieces)
        places, odd = np.flatnonzero(_IS_STEP[data]), _after_odd_quotes(data)
        for scan, commas, opened in zip(self.scans, self.commas, self.opened):
            at, change, after = scan.step(data, places, odd)
            commas.update(_counts(after[change == 0]))
            opened.update(_counts(after[data[at] == _OPEN]))
        if self.hashed:
            for piece in pieces.to_pylist():
                digest = int.from_bytes(hashlib.sha256(piece[:-1]).digest(), "big")
                self.content = (self.content * _BASE + digest) % _PRIME
            self.scale = self.scale * pow(_BASE, len(pieces), _PRIME) % _PRIME

    def text(self) -> str:
        return json.dumps([[[s.in_text, s.depth, list(c.items()), list(o.items())] for s, c, o in
                            zip(self.scans, self.commas, self.opened)], self.content, self.scale])


def _summaries(pieces: DataFrame, hashed: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key, summary):
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(
                (*key, summary.text()), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                ["file", "start", "length", "summary"])
        key = summary = None
        for found, some in _by_range(batches):
            if found != key:
                if key is not None:
                    yield row(key, summary)
                key, summary = found, _Summary(hashed)
            summary.add(some)
        if key is not None:
            yield row(key, summary)
    return pieces.mapInArrow(run, f"{_RANGE}, summary string")


def _beginnings(summaries: list) -> tuple[dict, dict]:
    """What each range begins with, ``(in_text, depth, position)`` (in a file that is
    not one whole array () for the first, which is to report it, and None), and the content hash of each file."""
    begins, content, of_file = {}, {}, {}
    for r in sorted(summaries, key=lambda r: (r["file"], r["start"])):
        of_file.setdefault(r["file"], []).append(r)
    for file, ranges in of_file.items():
        in_text, depth, position, arrays, total = False, 0, 0, 0, 0
        for r in ranges:
            cases, digest, scale = json.loads(r["summary"])
            begins[file, r["start"], r["length"]] = (in_text, depth, position)
            total = (total * scale + digest) % _PRIME
            ends_in_text, change, commas, opened = cases[in_text]
            position += dict(commas).get(1 - depth, 0)
            arrays += dict(opened).get(1 - depth, 0)
            in_text, depth = ends_in_text, depth + change
        # the last piece is scanned with a } that the file has not
        if in_text or depth != -1 or arrays != 1:
            begins.update({(file, r["start"], r["length"]): () if r is ranges[0] else None for r in ranges})
        content[file] = hashlib.sha256(str(total).encode()).hexdigest()
    return begins, content


class _Records:
    """Records of one range: whole ones, and pieces of those that cross its ends."""

    def __init__(self, begin: tuple[bool, int, int]):
        self.scan, self.position = Scan(*begin[:2]), begin[2]
        self.inside = begin[1] > 0     # between the array's brackets
        self.whole = False             # the record held began in this range
        self.held: list[bytes] = []

    def add(self, pieces: pa.Array) -> Iterator[tuple[np.ndarray, bool, pa.Array]]:
        """``(positions, whole, texts)`` of the records that end here."""
        data = _bytes_of(pieces)
        at, change, after = self.scan.step(data, np.flatnonzero(_IS_STEP[data]), _after_odd_quotes(data))
        cut = ((change == 0) & (after == 1)) | ((change == 1) & (after == 1)) | ((change == -1) & (after == 0))
        places, kinds = at[cut], change[cut]
        if not len(places):
            if self.inside:
                self.held.append(data.tobytes())
            return
        # a record ends at each place, if the array does not begin there or has ended before
        positions = self.position + np.cumsum(kinds == 0) - (kinds == 0)
        if self.inside:
            record = b"".join([*self.held, data[:places[0]].tobytes()])
            # else an empty array
            if record.strip() or not self.whole or self.position or kinds[0] != -1:
                yield positions[:1], self.whole, pa.array([record], pa.binary())
        if len(places) > 1:
            # its text begins with what ends the one before, made a space
            spaced = data.copy()
            spaced[places] = _SPACE
            texts = pa.Array.from_buffers(pa.binary(), len(places) - 1, [
                None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(spaced)])
            kept = kinds[:-1] != -1
            for i in np.flatnonzero((kinds[1:] == -1) & (positions[1:] == 0)).tolist():
                kept[i] &= bool(texts[i].as_py().strip())
            yield positions[1:][kept], True, texts if kept.all() else texts.filter(pa.array(kept))
        self.inside, self.whole, self.held = bool(kinds[-1] != -1), True, []
        self.position = int(positions[-1]) + int(kinds[-1] == 0)
        if self.inside:
            self.held.append(data[places[-1] + 1:].tobytes())

    def end(self) -> Iterator[tuple[np.ndarray, bool, pa.Array]]:
        if self.inside:
            yield np.array([self.position]), False, pa.array([b"".join(self.held)], pa.binary())


def read_array(spark: SparkSession, path: str, record: T.StructType, batch_id: str | None = None) -> DataFrame:
    """Records of the JSON-array files at ``path`` (file, folder or glob) with
    ``_source_file``, ``_pos`` (from 0, in the file's order) and ``batch_id``: the given one, or
    else a hash of the file's content, whatever ranges it was read in.

    A record that does not parse is a row of NULLs at its position, the others load. A file
    that is not one whole array (cut off, an object) is one row of NULLs; one without a byte
    has no row. A record must fit in a task's memory, a file need not. A failed or lost task is
    run again; if the ranges differ between the two readings (other settings), it raises.
    """
    return read_arrays(spark, [path], record, batch_id)


def read_arrays(spark: SparkSession, paths: Iterable[str], record: T.StructType, batch_id: str | None = None) -> DataFrame:
    """As :func:`read_array` for the files of several paths. What was read of a path is stored before the
    next one is asked for, so an iterator may write the files of a path and remove them afterwards."""
    found = stored_in_turn(spark, (_found(spark, path, record, batch_id) for path in paths), "json-array")
    crossing = (found.where(~F.col("whole")).groupBy("file", "content", "position")
                .agg(F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts"))
                .select("file", "content", "position", F.array_join(F.transform(
                    "parts", lambda p: p["part"].cast("string")), "").alias("text"))
                .select("file", "content", "position", F.from_json("text", record).alias("record")))
    whole = found.where("whole").select("file", "content", "position", "record")
    batch = F.lit(batch_id) if batch_id is not None else F.col("content")
    return whole.unionByName(crossing).select(
        F.col("file").alias("_source_file"), F.col("position").alias("_pos"), batch.alias("batch_id"), "record.*")


def _found(spark: SparkSession, path: str, record: T.StructType, batch_id: str | None) -> DataFrame:
    """The whole records, parsed, and the pieces of those that cross the ends of ranges, of one path's files."""
    pieces = _pieces(spark, path)
    summaries = _summaries(pieces, batch_id is None).collect()  # a small row for each range
    if len(summaries) > MAX_RANGES:
        raise ValueError(f"over {MAX_RANGES} ranges: load the files in several calls")
    begins, content = _beginnings(summaries)
    shipped = spark.sparkContext.broadcast((begins, content))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, content = shipped.value

        def rows(key, positions, whole, texts):
            n, named = len(positions), content[key[0]] if batch_id is None else None
            return pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(key[0], pa.string()), n), pa.repeat(key[1], n), pa.repeat(pa.scalar(named, pa.string()), n),
                 pa.array(positions, pa.int64()), pa.repeat(whole, n), texts],
                ["file", "start", "content", "position", "whole", "text"])
        key = records = None
        for found, some in _by_range(batches):
            if found != key:
                if records:
                    yield from (rows(key, *x) for x in records.end())
                key = found
                if key not in begins:
                    raise RuntimeError(f"the ranges of {key[0]} are others than in the first reading")
                records = _Records(begins[key]) if begins[key] else None  # None: nothing to read here
                if begins[key] == ():
                    yield rows(key, np.array([0]), True, pa.array([None], pa.binary()))
            if records:
                yield from (rows(key, *x) for x in records.add(some))
        if records:
            yield from (rows(key, *x) for x in records.end())

    found = pieces.mapInArrow(run, "file string, start long, content string, position long, whole boolean, text binary")
    parsed = F.from_json(F.col("text").cast("string"), record)
    return found.select("file", "start", "content", "position", "whole",
                        F.when(F.col("whole"), parsed).alias("record"),
                        F.when(~F.col("whole"), F.col("text")).alias("part"))
