"""Interpolated modified Kneser-Ney bigram model for perplexity.

Spark counts tokens, then pairs of tokens, over all training texts. The counts are kept
as sorted hash arrays in files of the shared folder, one for each part of the hash
space, and every scoring worker maps the files and looks its tokens up by binary search;
no part of the model is broadcast or held by the driver.

A token's number is its place in the order of the token hashes; a pair's key is the two
numbers in one 64-bit word. Contexts and continuations are sums over a part's pairs, so
a frequent word is spread over all parts and is never one task's group.

P(w | u) = max(c(u w) - D, 0) / c(u .) + (D1 N1(u .) + D2 N2(u .) + D3 N3+(u .)) / c(u .) * P(w)
P(w)     = max(N(. w) - D', 0) / N(. .) + (D1' n1 + D2' n2 + D3' n3+) / N(. .) / (V + 1)
with one unknown token beside the V known ones.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesoro.llm.hash_arrays import BLOCK, Held, bits_for, counted, packed, top_part, unblock, unpacked, width
from tesoro.llm.common import BODY, MapCache, mounted_path, prepare, read, shared_uri, steps, values, write_file

# Hash of the end token: no word holds a space.
END = xxhash.xxh64_intdigest(b" ")
# Text bytes of one part of the vocabulary and training tokens of one part of the pairs:
# what one task merges.
VOCABULARY_PART_BYTES = 32 << 20
PAIR_PART_TOKENS = 4_000_000
# Numbers of one part of the per-token tables.
NUMBERS_PER_PART = 1 << 18
# Model files that a worker keeps mapped (a process may hold some 65 000 maps).
OPEN_FILES = 32_768
UNKNOWN = -1


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (A-Z in lower case, ASCII white space separates), each text
    closed by the end token, and the number of tokens of each text."""
    split = [(t or b"").lower().split() for t in texts]
    digest = xxhash.xxh64_intdigest
    sizes = np.array([len(ws) + 1 for ws in split], dtype=np.int64)
    out = np.fromiter((h for ws in split for h in (*map(digest, ws), END)), dtype=np.uint64, count=int(sizes.sum()))
    return out, sizes


def _pair_part(parts: int):
    return lambda keys: (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _discounts(of_counts: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of keys seen 1, 2, 3, 4 times;
    0.5, 1, 1.5 where a small corpus lacks one of them."""
    n1, n2, n3, n4 = (int(x) for x in of_counts)
    if not min(n1, n2, n3, n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))


@dataclass
class BigramModel:
    """What a worker needs to map the model's files: ``folder`` holds ``token-P`` (sorted
    hashes) and ``count-P``, ``pair-P`` (sorted keys) and ``pairs-P`` (packed counts), and by
    ranges of numbers ``table-P`` with rows c(u .), N1, N2, N3+(u .), N(. w)."""
    folder: str
    vocabulary_bits: int
    offsets: np.ndarray      # first number of each vocabulary part, and V
    tokens: int              # N
    pair_parts: int = 1
    pair_of_counts: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    continuation_of_counts: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    continuation_kinds: np.ndarray = field(default_factory=lambda: np.zeros(3, np.int64))
    continuations: int = 0   # N(. .)

    @property
    def size(self) -> int:
        """V; also the number of the start context."""
        return int(self.offsets[-1])

    def _map(self, name: str, kind: str) -> np.ndarray:
        open_ = self.__dict__.setdefault("_open", MapCache("u1", OPEN_FILES))
        return open_[os.path.join(self.folder, name)].view(kind)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes; UNKNOWN for those not in training."""
        out = np.full(len(hashes), UNKNOWN, dtype=np.int64)
        part = top_part(self.vocabulary_bits)(hashes)
        for p in np.unique(part):
            at = slice(*np.searchsorted(part, [p, p + 1]))
            held = self._map(f"token-{p}", "<u8")
            if len(held):
                found = np.minimum(np.searchsorted(held, hashes[at]), len(held) - 1)
                out[at] = np.where(held[found] == hashes[at], self.offsets[p] + found, UNKNOWN)
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts of sorted numbers of known tokens."""
        out = np.zeros(len(numbers), dtype=np.int64)
        edges = np.searchsorted(numbers, self.offsets)
        for p in np.flatnonzero(np.diff(edges)):
            at = slice(edges[p], edges[p + 1])
            out[at] = self._map(f"count-{p}", "<u8")[numbers[at] - self.offsets[p]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Training counts of sorted distinct pair keys."""
        out = np.zeros(len(keys), dtype=np.int64)
        part = _pair_part(self.pair_parts)(keys)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.pair_parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            rows = order[edges[p]:edges[p + 1]]
            held = self._map(f"pair-{p}", "<u8")
            if len(held):
                found = np.minimum(np.searchsorted(held, keys[rows]), len(held) - 1)
                times = self._map(f"pairs-{p}", "u1")
                times = times.view(width(len(times), len(held)))
                out[rows] = np.where(held[found] == keys[rows], times[found], 0)
        return out

    def table(self, numbers: np.ndarray) -> np.ndarray:
        """``[number, 5]`` rows of the per-token tables for sorted numbers."""
        out = np.zeros((len(numbers), 5), dtype=np.int64)
        part = numbers // NUMBERS_PER_PART
        for p in np.unique(part):
            at = slice(*np.searchsorted(part, [p, p + 1]))
            held = self._map(f"table-{p}", "<u8").reshape(5, -1)
            if held.shape[1]:
                out[at] = held[:, numbers[at] - p * NUMBERS_PER_PART].T
        return out

    def score(self, texts: list[bytes | None]) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, the base score and the model's log10
        probability."""
        hashes, sizes = token_hashes(texts)
        starts = np.cumsum(sizes) - sizes
        unique, which = np.unique(hashes, return_inverse=True)
        number_of = self.numbers(unique)
        known = number_of >= 0
        count_of = np.zeros(len(unique), dtype=np.int64)
        count_of[known] = self.counts(number_of[known])
        number = number_of[which]
        context = np.r_[self.size, number[:-1]]
        context[starts] = self.size
        tables = np.zeros((len(unique) + 1, 5), dtype=np.int64)
        tables[np.flatnonzero(known)] = self.table(number_of[known])
        tables[-1] = self.table(np.array([self.size]))[0]
        row_of_context = np.r_[len(unique), which[:-1]]
        row_of_context[starts] = len(unique)
        both = (number >= 0) & (context >= 0)
        keys = (context[both].astype(np.uint64) << np.uint64(32)) | number[both].astype(np.uint64)
        distinct, of = np.unique(keys, return_inverse=True)
        pair = np.zeros(len(hashes), dtype=np.int64)
        pair[both] = self.pair_counts(distinct)[of] if len(distinct) else 0
        d = np.array([0.0, *_discounts(self.pair_of_counts)])
        dc = np.array([0.0, *_discounts(self.continuation_of_counts)])
        n = tables[:, 4]
        if self.continuations:
            lower_of = ((n - dc[np.minimum(n, 3)]).clip(0)
                        + (self.continuation_kinds @ dc[1:]) / (self.size + 1)) / self.continuations
        else:
            lower_of = np.full(len(tables), 1.0 / (self.size + 1))
        total = np.maximum(tables[:, 0], 1)
        back_of = np.where(tables[:, 0] > 0, tables[:, 1:4] @ d[1:] / total, 1.0)
        p = ((pair - d[np.minimum(pair, 3)]).clip(0) / total[row_of_context]
             + back_of[row_of_context] * lower_of[which])
        base = np.log10((count_of + 1) / (self.tokens + self.size + 1))[which]
        return {"n_tokens": sizes, "n_known": np.add.reduceat((count_of > 0)[which].astype(np.int64), starts),
                "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts)}


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def train(docs: DataFrame, folder: str) -> BigramModel:
    """Count all texts of ``docs`` (null: empty) and write the model below ``folder``, a
    URI on a store that all workers mount. Retried tasks replace files by equal ones."""
    texts = _text(docs)
    target = mounted_path(folder)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits_for(1 + size // VOCABULARY_PART_BYTES)

    def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(top_part(bits))
        for step in steps(batches, "text"):
            yield from held.add(token_hashes(values(step, "text"))[0])
        yield from held.flush()

    def write_tokens(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        keys, counts = unblock(table)
        write_file(f"{target}/token-{part}", keys.astype("<u8").tobytes())
        write_file(f"{target}/count-{part}", counts.astype("<u8").tobytes())
        return pa.table({"part": pa.array([part], pa.int32()), "size": pa.array([len(keys)], pa.int64()),
                         "n": pa.array([int(counts.sum())], pa.int64())})

    # one row for each part of the vocabulary
    found = (texts.mapInArrow(count_tokens, BLOCK).repartitionById(1 << bits, F.col("part")).groupBy("part")
                  .applyInArrow(write_tokens, "part int, size long, n long").collect())
    sizes = np.zeros(1 << bits, dtype=np.int64)
    for r in found:
        sizes[r["part"]] = r["size"]
    model = BigramModel(target, bits, np.r_[0, np.cumsum(sizes)], sum(r["n"] for r in found))
    if model.size >= 1 << 32:
        raise ValueError("over 2**32 distinct tokens: pair keys hold 32-bit numbers")
    model.pair_parts = 1 + model.tokens // PAIR_PART_TOKENS
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        held = Held(_pair_part(model.pair_parts))
        for step in steps(batches, "text"):
            hashes, sizes = token_hashes(values(step, "text"))
            unique, which = np.unique(hashes, return_inverse=True)
            number = model.numbers(unique)[which].astype(np.uint64)
            context = np.r_[np.uint64(model.size), number[:-1]]
            context[np.cumsum(sizes) - sizes] = model.size
            yield from held.add((context << np.uint64(32)) | number)
        yield from held.flush()

    def write_pairs(table: pa.Table) -> pa.Table:
        """A part's files, and what its pairs add to the contexts and continuations."""
        part = table["part"][0].as_py()
        keys, counts = unblock(table)
        write_file(f"{target}/pair-{part}", keys.astype("<u8").tobytes())
        write_file(f"{target}/pairs-{part}", packed(counts))
        context = (keys >> np.uint64(32)).astype(np.int64)
        number = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        kind = np.minimum(counts, 3)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        columns = [np.add.reduceat(x, first) for x in (counts, *((kind == k).astype(np.int64) for k in (1, 2, 3)))]
        word, times = counted(number)
        rows = []
        for p in np.unique(np.r_[context[first], word] // NUMBERS_PER_PART):
            a, b = np.searchsorted(context[first], [p * NUMBERS_PER_PART, (p + 1) * NUMBERS_PER_PART])
            c, d = np.searchsorted(word, [p * NUMBERS_PER_PART, (p + 1) * NUMBERS_PER_PART])
            rows.append((int(p), (context[first][a:b] - p * NUMBERS_PER_PART).astype("<u4").tobytes(),
                         packed(np.array([x[a:b] for x in columns])),
                         (word[c:d] - p * NUMBERS_PER_PART).astype("<u4").tobytes(), packed(times[c:d]),
                         [0] * 4 if rows else [int((counts == k).sum()) for k in (1, 2, 3, 4)]))
        names = ["part", "context", "sums", "word", "times", "seen"]
        kinds = [pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64())]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def write_table(table: pa.Table) -> pa.Table:
        """The per-token rows of a range of numbers."""
        part = table["part"][0].as_py()
        out = np.zeros((5, NUMBERS_PER_PART), dtype=np.int64)
        seen = np.zeros(4, dtype=np.int64)
        for r in table.to_pylist():
            at = np.frombuffer(r["context"], "<u4")
            out[:4, at] += unpacked(r["sums"], 4 * len(at)).reshape(4, -1)
            word = np.frombuffer(r["word"], "<u4")
            out[4, word] += unpacked(r["times"], len(word))
            seen += r["seen"]
        write_file(f"{target}/table-{part}", out.astype("<u8").tobytes())
        n = out[4]
        return pa.table({"seen": pa.array([seen.tolist()], pa.list_(pa.int64())),
                         "again": pa.array([[int((n == k).sum()) for k in (1, 2, 3, 4)]], pa.list_(pa.int64())),
                         "over": pa.array([int((n >= 3).sum())], pa.int64()), "all": pa.array([int(n.sum())], pa.int64())})

    # one row for each range of numbers
    # a task merges one part, however many there are
    tables = (texts.mapInArrow(count_pairs, BLOCK).repartitionById(model.pair_parts, F.col("part")).groupBy("part")
                   .applyInArrow(write_pairs, "part int, context binary, sums binary, word binary, times binary, seen array<long>")
                   .repartitionById(1 + model.size // NUMBERS_PER_PART, F.col("part")).groupBy("part").applyInArrow(write_table, "seen array<long>, again array<long>, over long, all long")
                   .collect())
    shipped.unpersist()
    model.pair_of_counts = sum((np.array(r["seen"]) for r in tables), np.zeros(4, np.int64))
    model.continuation_of_counts = sum((np.array(r["again"]) for r in tables), np.zeros(4, np.int64))
    model.continuation_kinds = np.r_[model.continuation_of_counts[:2], sum(r["over"] for r in tables)]
    model.continuations = sum(r["all"] for r in tables)
    return model


def score(docs: DataFrame, model: BigramModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``n_tokens``, ``n_known``, ``base_score``, ``score`` and
    ``perplexity`` (per token, end token included) of every row.

    Null and empty texts are the end token alone. Without training texts every token has
    probability one of the single unknown token. Repeated rows are scored each; columns
    besides ``keep`` and ``text`` are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, BODY):
            found = shipped.value.score(values(step, BODY))
            found["perplexity"] = 10.0 ** (-found["score"] / found["n_tokens"])
            yield pa.RecordBatch.from_arrays(
                [*(step.column(i) for i in range(step.num_columns - 1)), *map(pa.array, found.values())],
                [*step.schema.names[:-1], *found])

    narrow = docs.select(*keep, F.col("text").cast("binary").alias(BODY))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(
        run, f"{keys}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the model of six sevenths of them."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    model = train(docs.where(~F.col("held_out")), shared_uri(spark, "language-model"))
    return score(docs, model, keep=("doc_id", "held_out")).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", "perplexity")
