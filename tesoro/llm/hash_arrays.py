"""Counting 64-bit hashes in Spark with packed arrays: tasks count what they see, pass
the counts on in blocks by part of the hash space, and each part is merged by one task.
Sorted arrays of a part can be written to the shared folder and mapped by all workers.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesoro.llm.common import map_file, write_file

# Distinct keys that a counting task holds before it passes them on.
HELD_KEYS = 4_000_000


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def packed(counts: np.ndarray) -> bytes:
    """Counts in 32 bits each, or in 64 where one needs them."""
    return counts.astype("<u4" if not counts.size or int(counts.max()) < 1 << 32 else "<u8").tobytes()


def width(size: int, n: int) -> str:
    """The kind of ``n`` packed counts of ``size`` bytes."""
    return "<u8" if n and size == 8 * n else "<u4"


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, width(len(data), n)).astype(np.int64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


class Held:
    """Counts that a task gathers; passed on in blocks by part."""

    def __init__(self, part_of):
        self.part_of, self.keys, self.counts, self.size = part_of, [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from self.put(*counted(keys))

    def put(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > HELD_KEYS:
            self.keys, self.counts = ([x] for x in merged(self.keys, self.counts))
            self.size = len(self.keys[0])
            if self.size > HELD_KEYS // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        keys, counts = merged(self.keys, self.counts)
        self.keys, self.counts, self.size = [], [], 0
        part = self.part_of(keys)
        order = np.argsort(part, kind="stable")
        keys, counts, part = keys[order], counts[order], part[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(cuts, np.r_[cuts[1:], len(part)].astype(int)) if len(part) else []:
            one = counts[a:b] == 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[a])], pa.int32()), pa.array([keys[a:b][one].tobytes()], pa.binary()),
                 pa.array([keys[a:b][~one].tobytes()], pa.binary()),
                 pa.array([packed(counts[a:b][~one])], pa.binary())],
                ["part", "once", "more", "counts"])


BLOCK = "part int, once binary, more binary, counts binary"


def unblock(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The merged counts of a part's blocks."""
    once = [np.frombuffer(x, "<u8") for x in table["once"].to_pylist()]
    more = [np.frombuffer(x, "<u8") for x in table["more"].to_pylist()]
    counts = [unpacked(x, len(keys)) for x, keys in zip(table["counts"].to_pylist(), more)]
    return merged(once + more, [np.ones(len(x), np.int64) for x in once] + counts)


def bits_for(n: int) -> int:
    """Bits that number ``n`` parts."""
    return max(0, int(n - 1).bit_length())


def top_part(bits: int):
    """Part of a hash: its highest ``bits`` bits."""
    return lambda keys: (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


class HashSet:
    """A set of hashes in sorted files ``name-PART`` of ``folder``, mapped on use."""

    def __init__(self, folder: str, name: str, bits: int):
        self.folder, self.name, self.bits = folder, name, bits
        self._open: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def _part(self, part: int) -> np.ndarray:
        if part not in self._open:
            self._open[part] = map_file(os.path.join(self.folder, f"{self.name}-{part}"), "<u8")
        return self._open[part]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes are in the set."""
        unique, which = np.unique(hashes, return_inverse=True)
        found = np.zeros(len(unique), dtype=bool)
        part = top_part(self.bits)(unique)
        for p in np.unique(part):
            at = slice(*np.searchsorted(part, [p, p + 1]))
            held = self._part(int(p))
            if len(held):
                place = np.minimum(np.searchsorted(held, unique[at]), len(held) - 1)
                found[at] = held[place] == unique[at]
        return found[which]


def write_set(blocks: DataFrame, folder: str, name: str, bits: int, at_least: int = 1) -> HashSet:
    """The set of the hashes that the ``BLOCK`` rows count ``at_least`` times."""
    def write(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        keys, counts = unblock(table)
        write_file(os.path.join(folder, f"{name}-{part}"), keys[counts >= at_least].astype("<u8").tobytes())
        return pa.table({"part": pa.array([part], pa.int32())})
    blocks.groupBy("part").applyInArrow(write, "part int").count()
    return HashSet(folder, name, bits)


def count_blocks(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> DataFrame:
    """``BLOCK`` rows that count what ``hashes`` makes of the batches of ``rows``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(top_part(bits))
        for batch in batches:
            for found in hashes(batch):
                yield from held.add(found)
        yield from held.flush()
    return rows.mapInArrow(run, BLOCK)
