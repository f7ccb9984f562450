"""Token-id output: tokenize whole texts, write Re-Pair shard files in document order,
read them back.

Documents are range-partitioned by id and sorted, each task tokenizes its rows, packs
them into shards of about ``SHARD_TOKENS`` ids and writes every shard as one file of the
format in ``repair``. The files' manifest is a small Spark table; a document's global
token offset is its partition's offset plus what the partition has before it.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesoro.llm.common import mounted_path, prepare, read, shared_uri, steps, store, values, write_file
from tesoro.llm.repair import Shard, compress

TOKENIZER = "word_bpe_49k.json"  # of the public tokenizers; see tokenizer_path
END_ID = 1
# Token ids of one shard file (a longer document is a shard of its own).
SHARD_TOKENS = 1_000_000
# Chunks of text whose ids a worker remembers; when full, the memory starts anew.
CACHE_CHUNKS = 1_000_000
# Words that are encoded as one text.
JOINED_WORDS = 500
# Bytes of chunks that a worker remembers; when full, the memory starts anew.
CACHE_BYTES = 64 * 1024 * 1024
# Chunks of up to so many bytes are hashed and compared eight bytes at a time, all at once.
WORDWISE_BYTES = 64
# Bits of a chunk's hash that number the slots of a worker's memory.
SLOT_BITS = 21

# ASCII marks, a word, ASCII marks; without the apostrophe, which may join letters.
_CHUNK = re.compile(rb"([!-&(-/:-@\[-`{-~]*)([A-Za-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)")
# What is one pre-token for sure: ASCII and Latin-1 letters, or ASCII marks without the apostrophe.
_UNIT = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+")
# Kinds of bytes in _UNIT and between: white space, letters (the bytes of Latin-1 ones
# too), marks, and what else there is.
_GAP, _LETTER, _MARK, _OTHER = range(4)
_KINDS = bytes(_GAP if b in b"\t\n\v\f\r " else
               _LETTER if bytes([b]).isalpha() or b == 0xC3 or 0x80 <= b < 0xC0 and b not in (0x97, 0xB7) else
               _MARK if 33 <= b < 127 and b != 39 and not 48 <= b < 58 else _OTHER for b in range(256))

MANIFEST = "partition int, shard int, path string, n_docs long, n_tokens long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary file is."""
    import public_tokenizers
    return public_tokenizers.path(name)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SLOT_SHIFT = np.uint64(64 - SLOT_BITS)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _by_eights(data: bytes | np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as an integer; the last seven begin none."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def _eight(eights: np.ndarray, first: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th eight bytes of the spans, each longer than 8 k; zero beyond a span's end."""
    return eights[first + 8 * k] & _MASKS[np.minimum(sizes - 8 * k, 8)]


class _Chunks:
    """The white-space-free chunks of a text that ends in a space, or given spans of it."""

    def __init__(self, text: bytes, first: np.ndarray | None = None, sizes: np.ndarray | None = None):
        self.text = text
        if first is None:
            edge = np.flatnonzero(np.diff(_SPACE[np.frombuffer(text, dtype=np.uint8)], prepend=True))
            first = edge[::2]
            sizes = edge[1::2] - first
        self.first, self.sizes = first, sizes
        self.eights = _by_eights(text + bytes(8))
        self.heads = _eight(self.eights, first, sizes, 0)

    @classmethod
    def apart(cls, text: bytes) -> _Chunks:
        """The chunks of ``text``, those of ASCII and Latin-1 letters and of ASCII marks
        cut into letters, ASCII ones in lower case, and marks; the others stay whole as
        they are."""
        kinds = np.frombuffer(text.translate(_KINDS), dtype=np.uint8)
        first = np.r_[0, np.flatnonzero(kinds[1:] != kinds[:-1]) + 1]  # of runs of one kind
        kinds = kinds[first]
        begins = kinds != _GAP
        heads = begins & np.r_[True, ~begins[:-1]]  # runs that begin a chunk
        lower = text.lower()
        odd = np.flatnonzero(kinds == _OTHER)
        special = [m.start() for m in re.finditer(rb"<\|", text)]
        if len(odd) or special:
            chunk = np.cumsum(heads) - 1
            whole = np.zeros(chunk[-1] + 1, dtype=bool)
            whole[chunk[odd]] = True
            whole[chunk[np.searchsorted(first, special, side="right") - 1]] = True
            begins = heads | (begins & ~whole[chunk])
            changed = np.frombuffer(lower, dtype=np.uint8) != np.frombuffer(text, dtype=np.uint8)
            upper = np.flatnonzero(changed)
            upper = upper[whole[chunk[np.searchsorted(first, upper, side="right") - 1]]]
            kept = np.frombuffer(lower, dtype=np.uint8).copy()
            kept[upper] = np.frombuffer(text, dtype=np.uint8)[upper]
            lower = kept.tobytes()
        cuts = np.flatnonzero(begins | (kinds == _GAP))  # the last run is a gap
        edge, units = first[cuts], begins[cuts]
        return cls(lower, edge[units], np.diff(edge, append=len(text))[units])

    def __getitem__(self, i: int) -> bytes:
        return self.text[self.first[i]:self.first[i] + self.sizes[i]]

    def pick(self, at: np.ndarray) -> list[bytes]:
        first = self.first[at]
        return [self.text[a:b] for a, b in zip(first.tolist(), (first + self.sizes[at]).tolist())]

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the chunks, from their length and eight bytes at a time."""
        out = (self.sizes.astype(np.uint64) ^ self.heads) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
        at = np.arange(len(out))
        for k in range(1, WORDWISE_BYTES // 8):
            at = at[self.sizes[at] > 8 * k]
            if not len(at):
                break
            mixed = (out[at] ^ _eight(self.eights, self.first[at], self.sizes[at], k)) * np.uint64(0x9E3779B97F4A7C15)
            out[at] = mixed ^ (mixed >> np.uint64(32))
        for i in np.flatnonzero(self.sizes > WORDWISE_BYTES).tolist():
            out[i] = int.from_bytes(blake2b(self[i], digest_size=8).digest(), "little")
        return out


class _Memory:
    """Known chunks and their ids. An entry is a chunk's place in one flat byte array and
    its ids' place in one flat id array; sorted hashes lead to entries, and a chunk whose
    hash leads to other bytes is found by its bytes."""

    def __init__(self, kind: str):
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.entries = np.zeros(0, dtype=np.int64)
        self.text = np.zeros(8, dtype=np.uint8)  # eight bytes follow the last chunk
        self.slots = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        self.text_starts = np.zeros(1, dtype=np.int64)
        self.text_sizes = np.zeros(1, dtype=np.int64)
        self.heads = np.zeros(1, dtype=np.uint64)  # the chunks' first eight bytes
        self.ids = np.zeros(0, dtype=kind)
        self.id_starts = np.zeros(1, dtype=np.int64)
        self.id_sizes = np.zeros(1, dtype=np.int64)
        self.clashes: dict[bytes, int] = {}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash; -1 if it is not known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.entries[place], -1)

    def differ(self, entries: np.ndarray, chunks: _Chunks, among: np.ndarray) -> np.ndarray:
        """Numbers of the chunks ``among`` whose bytes are not those of their entries."""
        eights, other = _by_eights(self.text), []

        def keep(at: np.ndarray, equal: np.ndarray) -> np.ndarray:
            other.append(at[~equal])
            return at[equal]
        known = entries[among]
        at = keep(among, (self.heads[known] == chunks.heads[among]) & (self.text_sizes[known] == chunks.sizes[among]))
        for k in range(1, WORDWISE_BYTES // 8):
            at = at[chunks.sizes[at] > 8 * k]
            if not len(at):
                break
            sizes = chunks.sizes[at]
            at = keep(at, _eight(eights, self.text_starts[entries[at]], sizes, k)
                      == _eight(chunks.eights, chunks.first[at], sizes, k))
        at = at[chunks.sizes[at] > WORDWISE_BYTES]
        starts = self.text_starts[entries[at]].tolist()
        keep(at, np.array([self.text[a:a + chunks.sizes[i]].tobytes() == chunks[i] for i, a in zip(at.tolist(), starts)],
                          dtype=bool))
        return np.concatenate(other)

    def add(self, chunks: list[bytes], sizes: np.ndarray, ids: np.ndarray, hashes: np.ndarray | None = None) -> int:
        """Remember distinct chunks, whose ids follow each other, by hashes that are new
        and distinct, or without. Returns the first one's entry."""
        entry = len(self.id_sizes)
        lengths = np.array([len(c) for c in chunks], dtype=np.int64)
        starts, text = np.cumsum(lengths) - lengths, b"".join(chunks) + bytes(8)
        self.heads = np.r_[self.heads, _eight(_by_eights(text), starts, lengths, 0)]
        self.text_starts = np.r_[self.text_starts, len(self.text) - 8 + starts]
        self.text_sizes = np.r_[self.text_sizes, lengths]
        self.text = np.r_[self.text[:-8], np.frombuffer(text, dtype=np.uint8)]
        self.id_starts = np.r_[self.id_starts, len(self.ids) + np.cumsum(sizes) - sizes]
        self.id_sizes = np.r_[self.id_sizes, sizes]
        self.ids = np.r_[self.ids, ids]
        if hashes is not None:
            order = np.argsort(hashes)
            at = np.searchsorted(self.hashes, hashes[order])
            self.hashes = np.insert(self.hashes, at, hashes[order])
            self.entries = np.insert(self.entries, at, entry + order)
            slots = hashes >> _SLOT_SHIFT
            free = self.slots[slots] == 0  # what came first is the most frequent
            self.slots[slots[free]] = np.arange(entry, entry + len(hashes))[free]
        return entry

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and joined ids of the entries."""
        sizes = self.id_sizes[entries]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.id_starts[entries] - (ends - sizes), sizes)
        return sizes, self.ids[at]


def _letters(word: str) -> bool:
    """Whether a word is letters only, also as the tokenizer sees it (NFC, then lower
    case): some letters become a letter and a combining mark, which isn't one."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def _parts(chunk: bytes) -> tuple[bytes, ...]:
    """The parts that have their own ids: marks, letters, marks; else the chunk."""
    m = _CHUNK.fullmatch(chunk)
    if m and b"<|" not in chunk and _letters(m[2].decode()):
        return tuple(u for u in m.groups() if u)
    return (chunk,)


class WordTokenizer:
    """Ids of texts by a tokenizer that never joins across ASCII white space, as the
    default one, whose pre-tokenizer drops white space and cuts letters from marks. So a
    text's ids are those of its white-space-free chunks, and a chunk of letters and ASCII
    marks has the ids of its parts if the normalised words are letters only. With ASCII
    and Latin-1 letters they are, and the whole text is cut there at once; another chunk
    that is a word within marks is cut when it is first seen. The
    library encodes each part once a worker; many words are encoded as one text and told
    apart by the tokens that end a word. Chunks are found by 64-bit hashes and compared
    byte by byte; one that shares its hash with another is encoded by itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        top = max([*vocabulary.values(), self.size])
        self.kind = "<u2" if top < 1 << 16 else "<u4"
        self.ends = np.zeros(top + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memory = _Memory(self.kind)

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind) for e in found]

    def _entries(self, chunks: _Chunks, learn: Callable[[list[bytes], np.ndarray], None]) -> np.ndarray:
        """Memory entry of each chunk; ``learn`` adds distinct chunks of new hashes."""
        hashes = chunks.hashes()
        entries = self.memory.slots[hashes >> _SLOT_SHIFT].astype(np.int64)
        rest = self.memory.differ(entries, chunks, np.arange(len(entries)))
        if not len(rest):
            return entries
        unique, sample, which = np.unique(hashes[rest], return_index=True, return_inverse=True)
        new = self.memory.find(unique) < 0
        if new.any():
            learn(chunks.pick(rest[sample[new]]), unique[new])
        entries[rest] = self.memory.find(unique)[which]
        for i in self.memory.differ(entries, chunks, rest).tolist():
            chunk = chunks[i]
            if chunk not in self.memory.clashes:
                ids = self._whole([chunk])[0]
                self.memory.clashes[chunk] = self.memory.add([chunk], np.array([len(ids)]), ids)
            entries[i] = self.memory.clashes[chunk]
        return entries

    def _learn_parts(self, parts: list[bytes], hashes: np.ndarray, units: bool = False) -> None:
        """Encode distinct parts that are not known; ``units``: all are of ``_UNIT``."""
        sure = [i for i, p in enumerate(parts) if units or _UNIT.fullmatch(p) or _letters(p.decode())]
        done: list[int] = []
        sizes, flat = [], []
        for k in range(0, len(sure), JOINED_WORDS):
            group = sure[k:k + JOINED_WORDS]
            ids = self._whole([b" ".join([parts[i] for i in group])])[0]
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(group) and last[-1] == len(ids):
                done += group
                sizes.append(np.diff(last, prepend=0))
                flat.append(ids)
        known = np.zeros(len(parts), dtype=bool)
        known[done] = True
        alone = np.flatnonzero(~known).tolist()  # others, and those that the tokenizer cuts further
        found = self._whole([parts[i] for i in alone])
        order = done + alone
        self.memory.add([parts[i] for i in order],
                        np.concatenate([*sizes, [len(f) for f in found]]).astype(np.int64),
                        np.concatenate([*flat, *found, np.zeros(0, dtype=self.kind)]).astype(self.kind), hashes[order])

    def _learn(self, chunks: list[bytes], hashes: np.ndarray) -> None:
        """Remember distinct chunks that are not known."""
        units = np.array([_UNIT.fullmatch(c) is not None for c in chunks])
        if units.any():
            self._learn_parts([c for c, unit in zip(chunks, units.tolist()) if unit], hashes[units], units=True)
            chunks, hashes = [c for c, unit in zip(chunks, units.tolist()) if not unit], hashes[~units]
        if not chunks:
            return
        parts_of = [_parts(c) for c in chunks]
        flat = [p for parts in parts_of for p in parts]
        entries = self._entries(_Chunks(b" ".join(flat) + b" "), self._learn_parts)
        missing = self.memory.find(hashes) < 0  # a chunk that is its own part is there by now
        counts = np.array([len(parts) for parts in parts_of])
        sizes, ids = self.memory.gather(entries[np.repeat(missing, counts)])
        ends = np.cumsum(np.r_[0, sizes])[np.cumsum(np.r_[0, counts[missing]])]
        self.memory.add([c for c, m in zip(chunks, missing.tolist()) if m], np.diff(ends), ids, hashes[missing])

    def encode(self, texts: list[bytes | None], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, each closed by the end id, and the
        number of ids of each; null is the empty text."""
        if len(self.memory.id_sizes) > CACHE_CHUNKS or len(self.memory.text) > CACHE_BYTES:
            self.memory = _Memory(self.kind)
        chunks = _Chunks.apart(b" ".join([t or b"" for t in texts]) + b" ")
        sizes, ids = self.memory.gather(self._entries(chunks, self._learn))
        text_ends = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
        chunk_ends = np.searchsorted(chunks.first, text_ends)
        id_ends = np.r_[0, np.cumsum(sizes)][chunk_ends]
        counts = np.diff(id_ends, prepend=0)
        if end_id is not None:
            ids, counts = np.insert(ids, id_ends, end_id), counts + 1
        return ids.astype(self.kind, copy=False), counts


@lru_cache(maxsize=2)
def _word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _shards(batches: Iterator[pa.RecordBatch], tokenizer: WordTokenizer, shard_tokens: int
            ) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Documents of consecutive shards: names, token ids, and how many each has."""
    names: list[int | None] = []
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0
    for step in steps(batches, "text"):
        docs = values(step, "doc_id")
        ids, number = tokenizer.encode(values(step, "text"))
        ends = np.cumsum(number)
        first = 0
        while first < len(docs):  # as many documents as the shard takes
            before = int(ends[first - 1]) if first else 0
            last = int(np.searchsorted(ends, before + shard_tokens - size, side="right"))
            if last <= first:
                if names:
                    yield names, np.concatenate(held), np.concatenate(counts)
                    names, held, counts, size = [], [], [], 0
                    continue
                last = first + 1
            names += docs[first:last]
            held.append(ids[before:int(ends[last - 1])])
            counts.append(number[first:last])
            size += int(ends[last - 1]) - before
            first = last
    if names:
        yield names, np.concatenate(held), np.concatenate(counts)


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs`` (``doc_id``, ``text``) to shard files below ``folder``, a URI on a
    store that all workers mount, in ascending id order (null ids first, equal ids by
    text). Returns the manifest of the files, stored.

    A shard is written under a temporary name and moved into place, so retried tasks
    replace files by equal ones. Null texts are empty documents: the end id alone.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    target = mounted_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, words = TaskContext.get().partitionId(), _word_tokenizer(path)
        for k, (ids, tokens, counts) in enumerate(_shards(batches, words, shard_tokens)):
            starts = np.r_[0, np.cumsum(counts)]
            shard = compress(ids, tokens, starts, words.size)
            file = os.path.join(target, f"part-{partition:06d}-{k:06d}.rpr")
            write_file(file, shard.to_bytes())
            yield pa.RecordBatch.from_pydict({"partition": pa.array([partition], pa.int32()),
                                              "shard": pa.array([k], pa.int32()), "path": [file],
                                              "n_docs": [len(ids)], "n_tokens": [int(starts[-1])]})

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
                   .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    return store(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files.
    ``start`` is the number of token ids of all documents before it."""
    spark = manifest.sparkSession
    sizes = manifest.groupBy("partition").agg(F.sum("n_tokens").alias("n")).orderBy("partition").collect()
    offsets, total = {}, 0  # one number for each partition of the writing job
    for r in sizes:
        offsets[r["partition"]] = total
        total += r["n"]
    before = spark.sparkContext.broadcast(offsets)
    within = F.sum("n_tokens").over(Window.partitionBy("partition").orderBy("shard"))
    files = manifest.withColumn("before", within - F.col("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open(row["path"], "rb") as f:
                    shard = Shard.from_bytes(f.read())
                tokens = shard.decode().astype("<u4", copy=False)
                at = shard.token_starts
                crcs = [zlib.crc32(tokens[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                start = before.value[row["partition"]] + row["before"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.ids, pa.int64()), pa.array(at[:-1] + start, pa.int64()),
                     pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, spark.sparkContext.defaultParallelism, len(offsets))
    return files.repartition(tasks, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    manifest = write_shards(docs, shared_uri(docs.sparkSession, "token-shards"), tokenizer)
    return read_shards(manifest)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global offset, length and checksum of every document's token ids."""
    prepare(spark)
    return token_output(read(spark, sf_dir, "documents"))
