"""Removal of repeated word sequences with compressed FM-indexes and matching statistics.

A string of ``WINDOW`` words is a window. The corpus is cut into words once and stored in
chunks of documents. What is shared between chunks is routed by content, so that neither
every document meets every index nor a frequent passage meets one task:

* The anchor of a window is the leftmost of its strings of ``ANCHOR`` words with the
  smallest hash. Equal windows have equal anchors at equal places, so only windows whose
  anchor occurs in another document, too, can repeat. A segment is a run of windows with
  one anchor; it goes to the shard of the anchor's hash.
* A chunk sends each distinct segment once, with the smallest document id that has it; a
  shard merges equal segments, exactly. Its text, the distinct segments by ascending id, is
  indexed by a compressed FM-index (``match_index``): backward search over a wavelet tree
  streams all segments through it and gives the matching statistics, cut at ``WINDOW``;
  where they reach it, the suffix range tells the smallest id that has the window.
* The chunk gets these ids back and marks the windows of its documents that begin in a
  document with a smaller one.

Hashes only route: words and segments are compared as they are. No text is shuffled but
the distinct segments: what a chunk gets back lies in a file of the shared folder for each
few chunks, which the next scan of the corpus opens.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesoro.llm.common import mounted_path, prepare, read, shared_uri, shuffles_go, steps, store, values, write_file
from tesoro.llm.hash_arrays import bits_for, top_part
from tesoro.llm.match_index import MatchIndex

WINDOW = 13
ANCHOR = 5
# Text bytes of a chunk (a longer document is one of its own) and of a shard.
CHUNK_BYTES = 2 << 20
PART_BYTES = 16 << 20
LEAST_PARTS = 16
# Words whose anchors are looked for at a time; a place in them takes PLACE_BITS bits.
SECTION = 1 << 20
PLACE_BITS = np.uint64(21)
# Chunks of a writing task whose answers are in one file: 2 ** GROUP_BITS.
GROUP_BITS = 5
# In place of a null id, and of no document: larger than any id.
LAST = np.iinfo(np.int64).max

CHUNKS = "ids array<long>, sizes binary, n_bytes long, numbers binary, words binary"
_MARKS = "chunk long, keys binary"
_SEGMENTS = "part int, chunk long, keys binary, lengths binary, ids binary, numbers binary, words binary"
_FOUND = "chunk long, part int, keys binary, least binary"
_ROWS = "n_words long, n_removed long, kept_sha256 string, removed array<struct<first:long,last:long>>"


def encoded(ids: list[int | None], texts: list[bytes]) -> dict:
    """Documents as numbers of words, and the words these stand for."""
    split = [t.split() for t in texts]
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in chain.from_iterable(split)), dtype="<u4")
    return {"ids": ids, "sizes": np.array([len(s) for s in split], dtype="<i8").tobytes(),
            "n_bytes": sum(map(len, texts)), "numbers": numbers.astype(_kind(len(known))).tobytes(),
            "words": b" ".join(known)}


def _kind(words: int) -> str:
    """Of the numbers of so many words."""
    return "<u2" if words <= 1 << 16 else "<u4"


def _encode(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("n_bytes", pa.int64()),
                        ("numbers", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in steps(batches, "text"):
            for doc, text in zip(values(batch, "doc_id"), values(batch, "text")):
                text = text or b""
                if texts and size + len(text) > CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist([encoded(ids, texts)], schema)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(text)
                size += len(text) + 8
        if texts:
            yield pa.RecordBatch.from_pylist([encoded(ids, texts)], schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, CHUNKS).withColumn("chunk", F.monotonically_increasing_id())


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


@dataclass
class Segments:
    """Runs of windows of a chunk with one anchor: first window and number of windows (as
    places in the chunk's words), document (as a place in the chunk) and anchor hash."""
    first: np.ndarray
    windows: np.ndarray
    doc: np.ndarray
    key: np.ndarray

    def of(self, rows: np.ndarray) -> Segments:
        return Segments(self.first[rows], self.windows[rows], self.doc[rows], self.key[rows])


class Chunk:
    def __init__(self, row: dict, width: int):
        self.ids = np.array([LAST if x is None else x for x in row["ids"]], dtype=np.int64)
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.words = row["words"].split(b" ")
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), dtype="<u8", count=len(self.words))
        self.numbers = np.frombuffer(row["numbers"], _kind(len(self.words))).astype("<u4")
        self.ends = np.cumsum(self.sizes)
        self.width, self.row = width, row

    def segments(self) -> Segments:
        """All segments in order; documents shorter than a window have none."""
        size, n = min(ANCHOR, self.width), len(self.numbers)
        parts: list[tuple[np.ndarray, ...]] = []
        for at in range(0, n - self.width + 1, SECTION):
            words = self.hashes[self.numbers[at:at + SECTION + self.width - 1]]
            grams = np.zeros(len(words) - size + 1, dtype=np.uint64)
            for j in range(size):
                grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[j:j + len(grams)]
            grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            grams ^= grams >> np.uint64(29)
            place = np.arange(len(grams), dtype=np.uint64)
            least = _sliding_min((grams >> PLACE_BITS << PLACE_BITS) | place, self.width - size + 1)
            anchor = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
            window = np.arange(at, at + len(anchor))
            doc = np.searchsorted(self.ends, window, side="right")
            inside = window + self.width <= self.ends[doc]
            window, doc, anchor = window[inside], doc[inside], anchor[inside]
            if len(window):
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
                # anchors have small hashes: mixed anew, so that they spread over all shards
                key = grams[anchor[new]] * np.uint64(0xD6E8FEB86659FD93)
                parts.append((window[new], np.diff(np.r_[new, len(window)]), doc[new], key ^ (key >> np.uint64(32))))
        if not parts:
            none = np.zeros(0, dtype=np.int64)
            return Segments(none, none, none, np.zeros(0, dtype=np.uint64))
        return Segments(*(np.concatenate(x) for x in zip(*parts)))

    def wanted(self, keys: np.ndarray) -> tuple[Segments, np.ndarray, np.ndarray, np.ndarray]:
        """The segments with one of the ``keys``, sorted by key; for each the number of its
        distinct content, numbered by key; and of each content a segment, its smallest id."""
        found = self.segments()
        keys = np.sort(keys)
        at = np.minimum(np.searchsorted(keys, found.key), len(keys) - 1)
        found = found.of(np.flatnonzero(keys[at] == found.key))
        found = found.of(np.argsort(found.key, kind="stable"))
        data, known, which = self.numbers.tobytes(), {}, []
        for first, last in zip((4 * found.first).tolist(), (4 * (found.first + found.windows + self.width - 1)).tolist()):
            which.append(known.setdefault(data[first:last], len(known)))
        which = np.array(which, dtype=np.int64)
        sample = np.unique(which, return_index=True)[1]
        least = np.full(len(sample), LAST)
        np.minimum.at(least, which, self.ids[found.doc])
        return found, which, sample, least


def _parts_of(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """``(part, first, last)`` of the runs of sorted keys by part."""
    part = top_part(bits)(keys)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    yield from zip(part[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(part)])


def _anchors(corpus: DataFrame, width: int, bits: int) -> DataFrame:
    """Each chunk's anchor hashes by part; the lowest bit tells that several documents of
    the chunk have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = Chunk(row, width).segments()
                order = np.argsort(found.key, kind="stable")  # documents ascend within a key
                key, doc = found.key[order], found.doc[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                last = np.r_[first[1:], len(key)][:len(first)] - 1
                keys = (key[first] & ~np.uint64(1)) | (doc[first] != doc[last]).astype(np.uint64)
                runs = list(_parts_of(keys, bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in runs], pa.int32()), pa.array([row["chunk"]] * len(runs), pa.int64()),
                     pa.array([keys[a:b].tobytes() for _, a, b in runs], pa.binary())], ["part", "chunk", "keys"])
    return corpus.mapInArrow(run, f"part int, {_MARKS}")


def _repeated(table: pa.Table) -> pa.Table:
    """Of a part's anchor hashes those that several documents have, by chunk."""
    blocks = [np.frombuffer(x, "<u8") for x in table["keys"].to_pylist()]
    keys = np.concatenate(blocks)
    unique, which, times = np.unique(keys >> np.uint64(1), return_inverse=True, return_counts=True)
    repeated = times > 1
    repeated[which[(keys & np.uint64(1)) == 1]] = True
    marks = np.split(repeated[which], np.cumsum([len(b) for b in blocks])[:-1])
    rows = [(c, (b[m] >> np.uint64(1)).tobytes()) for c, b, m in zip(table["chunk"].to_pylist(), blocks, marks) if m.any()]
    return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "keys": pa.array([k for _, k in rows], pa.binary())})


def _all_keys(found: Segments, halves: list[bytes]) -> np.ndarray:
    """Of a chunk's segments the keys whose upper 63 bits are among ``halves``."""
    wanted = np.frombuffer(b"".join(halves), "<u8")
    unique = np.unique(found.key)
    return unique[np.isin(unique >> np.uint64(1), wanted)]


class Answers:
    """Rows for chunks, in a file for each group of them; a chunk's rows are found in it."""

    def __init__(self, rows: DataFrame, folder: str):
        self.folder = folder
        names = rows.columns

        def write(table: pa.Table) -> pa.Table:
            group = table["group"][0].as_py()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, table.select(names).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for chunk in sorted(set(table["chunk"].to_pylist())):
                    own = table.select(names).filter(pc.equal(table["chunk"], chunk)).combine_chunks()
                    out.write_batch(own.to_batches()[0])
            write_file(os.path.join(folder, f"group-{group}"), sink.getvalue())
            return pa.table({"n": pa.array([table.num_rows], pa.int64())})

        grouped = rows.withColumn("group", F.shiftright("chunk", GROUP_BITS)).groupBy("group")
        grouped.applyInArrow(write, "n long").agg(F.sum("n")).first()
        self._group, self._rows = None, {}

    def __getstate__(self):
        return {"folder": self.folder, "_group": None, "_rows": {}}

    def of(self, chunk: int) -> list[dict]:
        group = chunk >> GROUP_BITS
        if group != self._group:
            self._group, self._rows = group, {}
            path = os.path.join(self.folder, f"group-{group}")
            if os.path.exists(path):
                self._file = pa.ipc.open_file(pa.memory_map(path))
                for i in range(self._file.num_record_batches):
                    self._rows[self._file.get_batch(i).column("chunk")[0].as_py()] = i
        return self._file.get_batch(self._rows[chunk]).to_pylist() if chunk in self._rows else []


def _over(corpus: DataFrame, answers: Answers, run: Callable[[dict, list[dict]], pa.Table], schema: str) -> DataFrame:
    """What ``run`` makes of each chunk and its answers."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from run(row, answers.of(row["chunk"])).to_batches()
    return corpus.mapInArrow(each, schema)


def _send(row: dict, marks: list[dict], width: int, bits: int) -> pa.Table:
    """A chunk's distinct segments with repeated anchors, by part."""
    rows = []
    if marks:
        one = Chunk(row, width)
        found, which, sample, least = one.wanted(_all_keys(one.segments(), [m["keys"] for m in marks]))
        words = one.words
        key, lengths = found.key[sample], (found.windows[sample] + width - 1)
        for part, a, b in _parts_of(key, bits):
            numbers = np.concatenate([one.numbers[f:f + n] for f, n in zip(found.first[sample[a:b]].tolist(), lengths[a:b].tolist())])
            used, local = np.unique(numbers, return_inverse=True)
            rows.append((part, row["chunk"], np.unique(key[a:b]).tobytes(), lengths[a:b].astype("<u4").tobytes(),
                         least[a:b].tobytes(), local.astype(_kind(len(used))).tobytes(),
                         b" ".join([words[i] for i in used.tolist()])))
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
    names = ["part", "chunk", "keys", "lengths", "ids", "numbers", "words"]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def match_shard(segments: list[bytes], ids: list[int], width: int) -> list[np.ndarray]:
    """For each window of each distinct segment (word numbers as 32-bit integers of 1 or
    more) the smallest id of the segments that have it."""
    order = np.argsort(np.array(ids), kind="stable")
    sizes = np.array([len(s) // 4 for s in segments])
    words = np.frombuffer(b"".join([x for i in order.tolist() for x in (segments[i], b"\1\0\0\0")]), "<u4").astype(np.int64)
    ends = np.cumsum(sizes[order] + 1) - 1
    starts = ends - sizes[order]
    index = MatchIndex(words, width, np.repeat(np.arange(len(order)), sizes[order] + 1))
    least = np.full(len(words), len(order))
    for places, lengths, low, high in index.statistics(words, starts, ends):
        whole = np.flatnonzero(lengths == width)
        least[places[whole]] = index.least_owner(low[whole], high[whole])
    sorted_ids = np.r_[np.array(ids, dtype=np.int64)[order], LAST]
    out: list[np.ndarray] = [None] * len(order)
    for i, a, b in zip(order.tolist(), starts.tolist(), ends.tolist()):
        out[i] = sorted_ids[least[a:b - width + 1]]
    return out


def _match(table: pa.Table, width: int) -> pa.Table:
    """The shard of a part: merges, indexes and streams its segments; for each chunk the
    smallest id of each window of its distinct segments, in their order."""
    vocabulary: dict[bytes, int] = {}
    known: dict[bytes, int] = {}
    least: list[int] = []
    blocks = []
    for row in table.to_pylist():
        here = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in row["words"].split(b" ")]
        local = np.frombuffer(row["numbers"], _kind(len(here)))
        data, which, at = np.array(here, dtype="<u4")[local].tobytes(), [], 0
        for length, doc in zip(np.frombuffer(row["lengths"], "<u4").tolist(), np.frombuffer(row["ids"], "<i8").tolist()):
            number = known.setdefault(data[at:at + 4 * length], len(known))
            at += 4 * length
            if number == len(least):
                least.append(doc)
            elif doc < least[number]:
                least[number] = doc
            which.append(number)
        blocks.append((row["chunk"], row["part"], row["keys"], which))
    found = match_shard(list(known), least, width)
    return pa.Table.from_arrays(
        [pa.array([b[0] for b in blocks], pa.int64()), pa.array([b[1] for b in blocks], pa.int32()),
         pa.array([b[2] for b in blocks], pa.binary()),
         pa.array([np.concatenate([found[i] for i in b[3]]).tobytes() for b in blocks], pa.binary())],
        ["chunk", "part", "keys", "least"])


def _result(row: dict, found: list[dict], width: int, keep_text: bool) -> pa.Table:
    """The rows of a chunk's documents."""
    one = Chunk(row, width)
    removed = np.zeros(len(one.numbers) + 1, dtype=np.int64)
    blocks = sorted(found, key=lambda b: b["part"])
    if blocks:
        segments, which, sample, _ = one.wanted(np.frombuffer(b"".join([b["keys"] for b in blocks]), "<u8"))
        least = np.frombuffer(b"".join([b["least"] for b in blocks]), "<i8")
        begins = np.cumsum(segments.windows[sample]) - segments.windows[sample]
        ends = np.cumsum(segments.windows)
        within = np.arange(ends[-1]) - np.repeat(ends - segments.windows, segments.windows)
        window = np.repeat(segments.first, segments.windows) + within
        smaller = least[np.repeat(begins[which], segments.windows) + within] \
            < np.repeat(one.ids[segments.doc], segments.windows)
        np.add.at(removed, window[smaller], 1)
        np.add.at(removed, window[smaller] + width, -1)
    removed = np.cumsum(removed)[:-1] > 0
    words = np.array(one.words, dtype=object)[one.numbers] if len(one.numbers) else np.zeros(0, object)
    rows = []
    for doc, a, b in zip(row["ids"], (one.ends - one.sizes).tolist(), one.ends.tolist()):
        gone = removed[a:b]
        kept = b" ".join(words[a:b][~gone])
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
        rows.append({"doc_id": doc, "n_words": b - a, "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(),
                     "removed": [{"first": x, "last": y} for x, y in zip(edge[::2], edge[1::2])]})
        if keep_text:
            rows[-1]["kept"] = kept.decode()
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
    schema = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
              ("removed", pa.list_(span))] + [("kept", pa.string())] * keep_text
    return pa.Table.from_pylist(rows, pa.schema(schema))


def drop_repeated_words(docs: DataFrame, width: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (``doc_id`` that casts to long, ``text``): ``doc_id,
    n_words, n_removed, kept_sha256``, ``removed`` (word ranges [first, last)) and, if asked
    for, ``kept`` (the kept words joined by one space).

    A word goes if a window of ``width`` words that covers it also begins in a document
    with a smaller id. Rows with equal ids don't remove each other's words; rows without
    an id lose what any row with an id has, and remove nothing. Null and empty texts have no
    words, texts shorter than a window lose none. Very long texts are a chunk each. Other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    uri = shared_uri(spark, "word-chunks")
    _encode(docs).write.parquet(uri, compression="zstd")
    corpus = spark.read.schema(f"{CHUNKS}, chunk long").parquet(uri)
    size = corpus.agg(F.sum("n_bytes")).first()[0] or 0
    bits = bits_for(max(LEAST_PARTS, int(size) // PART_BYTES))
    folder = lambda name: mounted_path(shared_uri(spark, name))
    with shuffles_go(spark):
        # more partitions than parts, so that parts don't pile up in a task
        marks = Answers(_anchors(corpus, width, bits).repartition(4 << bits, "part").groupBy("part").applyInArrow(_repeated, _MARKS), folder("marks"))
        sent = _over(corpus, marks, lambda row, keys: _send(row, keys, width, bits), _SEGMENTS)
        found = Answers(store(sent.repartition(4 << bits, "part").groupBy("part").applyInArrow(
            lambda table: _match(table, width), _FOUND), "window-ids"), folder("windows"))
    out = f"doc_id long, {_ROWS}" + ", kept string" * keep_text
    return _over(corpus, found, lambda row, ids: _result(row, ids, width, keep_text), out)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in windows that an earlier document has."""
    prepare(spark)
    return drop_repeated_words(read(spark, sf_dir, "documents")).drop("removed")


# The same with every window as a string.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT x, min(doc_id) AS first_doc FROM windows GROUP BY x),
hit AS (SELECT DISTINCT doc_id, i + j AS i
        FROM (SELECT windows.doc_id, windows.i FROM windows JOIN least USING (x) WHERE first_doc < windows.doc_id),
             (SELECT unnest(range(0, 13)) AS j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE hit.i IS NULL) AS text,
                CAST(count(*) AS BIGINT) AS n_words, CAST(count(hit.i) AS BIGINT) AS n_removed
         FROM words LEFT JOIN hit ON hit.doc_id = words.doc_id AND hit.i = words.i GROUP BY words.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
