"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents. Its words become small integers: words that no
benchmark item has can't be part of an occurrence, so runs of benchmark words that
are at least as long as the shortest test phrase are all that the index has to hold,
each run closed by a separator. Backward search finds the suffix range of every test
phrase, sampled suffix positions turn the ranges into places, and overlapping places
are merged into removal spans.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesoro.llm.common import BODY, prepare, read, steps, store, values
from tesoro.llm.fm_index import FMIndex

WINDOW_WORDS = 10
# Benchmark text that one pass ships to the workers; a larger benchmark takes more passes.
BLOCK_BYTES = 16 * 1024 * 1024
# Text bytes of a training shard (a longer document is a shard of its own).
SHARD_BYTES = 4 * 1024 * 1024
# Test phrases that are searched at a time.
SEARCHED = 200_000

# A-Z in lower case; digits, letters and all bytes of other characters stay; the rest
# separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))

_SPAN = "array<struct<first:int,last:int>>"
# Word ranges and the byte ranges that they span.
_RANGES = "array<struct<first:int,last:int,start:int,end:int>>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and each key's number among the distinct ones."""
    order = np.argsort(keys)
    new = np.diff(keys[order], prepend=-1) != 0
    which = np.empty(len(keys), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _named(keys: np.ndarray) -> np.ndarray:
    """Equal numbers below the length for equal keys."""
    return _distinct(keys)[1]


class Phrases:
    """Test phrases of a block of benchmark items: the window of every ``width``
    consecutive words, or the whole item if it is shorter, as word numbers. A distinct
    phrase is a place and a length in the items' joined words; items without an id have
    phrases but own none."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        vocabulary, numbers, counts = self.vocabulary, array("i"), []
        for _, text in items:
            found = words(text)
            numbers.extend([vocabulary.setdefault(w, len(vocabulary) + 2) for w in found])
            counts.append(len(found))
        self.numbers = np.array(numbers, dtype=np.int32)
        counts = np.array(counts, dtype=np.int64)
        begins = np.cumsum(counts) - counts
        sizes = np.minimum(counts, width)
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        item = np.array([number.get(name, -1) for name, _ in items], dtype=np.int64)
        # names of the words of 1, 2, 4, ... places from each place on: two of them name a window
        n, half, names = len(self.numbers), 1, self.numbers.astype(np.int64)
        starts, lengths, owned = [], [], []
        total = 0
        for size in np.unique(sizes[sizes > 0]).tolist():
            of = np.flatnonzero(sizes == size)
            windows = counts[of] - size + 1
            at = np.arange(windows.sum()) + np.repeat(begins[of] - (np.cumsum(windows) - windows), windows)
            while 2 * half <= size:
                names, half = _named(names[:-half] * (n + 2) + names[half:]), 2 * half
            first, which = _distinct(names[at] * (n + 2) + names[at + size - half])
            starts.append(at[first])
            lengths.append(np.full(len(first), size, dtype=np.int64))
            owner = np.repeat(item[of], windows)
            pairs = np.sort(((total + which) * (len(self.names) + 1) + owner)[owner >= 0])
            owned.append(pairs[np.diff(pairs, prepend=-1) != 0])
            total += len(first)
        empty = np.zeros(0, dtype=np.int64)
        self.starts = np.concatenate([empty, *starts])
        self.lengths = np.concatenate([empty, *lengths])
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        phrase, self.owners = np.divmod(np.concatenate([empty, *owned]), len(self.names) + 1)
        self.owner_ends = np.searchsorted(phrase, np.arange(total + 1))  # where a phrase's owners begin

    def table(self, first: int, last: int) -> np.ndarray:
        """Phrases ``first`` up to ``last``, one a row, right-aligned, 0 before them."""
        lengths = self.lengths[first:last]
        width = int(lengths.max(initial=1))
        back = np.arange(-width, 0)
        at = (self.starts[first:last] + lengths)[:, None] + back
        return np.where(back >= -lengths[:, None], self.numbers[np.maximum(at, 0)], 0).astype(np.int64)

    def items(self, phrases: np.ndarray) -> list[str]:
        """Sorted ids of the items that have any of the phrases."""
        found = [self.owners[self.owner_ends[p]:self.owner_ends[p + 1]] for p in phrases.tolist()]
        return [self.names[i] for i in np.unique(np.concatenate(found)).tolist()] if found else []


# The phrases that a worker holds: those of the last broadcast block.
_HELD: dict[str, Phrases] = {}


def _phrases(key: str, block: Callable[[], list], width: int) -> Phrases:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Phrases(block(), width)
    return _HELD[key]


def _runs(marks: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True of at least ``shortest``."""
    edge = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= shortest
    return starts[long], ends[long]


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of the word ranges [start, end), touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search_shard(texts: list[bytes | None], wanted: Phrases) -> tuple[list[int], list[list], list[list[str]]]:
    """Word count, merged hit ranges and found item names of each text."""
    get = wanted.vocabulary.get
    counts, pieces, places = [], [], []  # places: (text, first word) of each piece
    sizes = []
    for number, text in enumerate(texts):
        found = words(text)
        counts.append(len(found))
        if not wanted.shortest or len(found) < wanted.shortest:
            continue
        numbers = np.fromiter((get(w, 0) for w in found), dtype=np.int64, count=len(found))
        for a, b in zip(*_runs(numbers > 0, wanted.shortest)):
            pieces.append(np.r_[numbers[a:b], 1])  # 1 separates
            places.append((number, int(a)))
            sizes.append(int(b - a) + 1)
    hits: list[list] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not pieces:
        return counts, hits, items
    index = FMIndex(np.concatenate(pieces))
    phrase, rows = [], []
    for begin in range(0, len(wanted.lengths), SEARCHED):
        low, high = index.search(wanted.table(begin, begin + SEARCHED), wanted.lengths[begin:begin + SEARCHED])
        found = np.flatnonzero(high > low)
        repeats = (high - low)[found]
        phrase.append(np.repeat(found, repeats) + begin)
        rows.append(np.arange(repeats.sum()) + np.repeat(low[found] - (np.cumsum(repeats) - repeats), repeats))
    phrase, rows = np.concatenate(phrase), np.concatenate(rows)
    position = index.locate(rows)
    begins = np.cumsum([0, *sizes])[:-1]
    piece = np.searchsorted(begins, position, side="right") - 1
    owner = np.array([n for n, _ in places], dtype=np.int64)[piece]
    first = position - begins[piece] + np.array([a for _, a in places], dtype=np.int64)[piece]
    by = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.r_[True, owner[by][1:] != owner[by][:-1]]) if len(by) else []
    for group in np.split(by, cuts[1:]) if len(by) else []:
        number = int(owner[group[0]])
        hits[number] = _merged(first[group], first[group] + wanted.lengths[phrase[group]])
        items[number] = wanted.items(np.unique(phrase[group]))
    return counts, hits, items


def _word_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of word ranges, from the first word's first byte to the last
    word's last."""
    mapped = np.frombuffer(text.translate(WORD_BYTES), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, mapped, False].astype(np.int8)))
    return [(int(edge[2 * a]), int(edge[2 * b - 1])) for a, b in ranges]


def _find(docs: DataFrame, block: list[tuple[str | None, bytes | None]], width: int) -> DataFrame:
    wanted, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases(key, lambda: wanted.value, width)
        for shard in steps(batches, BODY, SHARD_BYTES):
            texts = values(shard, BODY)
            counts, hits, items = search_shard(texts, phrases)
            spans = [_word_spans(t, h) if h else [] for t, h in zip(texts, hits)]
            as_structs = lambda found: [[{"first": a, "last": b} for a, b in x] for x in found]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*(shard.column(i) for i in range(shard.num_columns - 1)), pa.array(counts, pa.int64()),
                 pa.array(as_structs(hits), kind), pa.array(as_structs(spans), kind),
                 pa.array(items, pa.list_(pa.string()))],
                [*shard.schema.names[:-1], "n_words", "hit", "spans", "items"])

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{keys}, n_words long, hit {_SPAN}, spans {_SPAN}, items array<string>")


def _blocks(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[str | None, bytes | None]]]]:
    """Number of blocks, and the distinct items in blocks of about BLOCK_BYTES each, dealt
    by a hash of the row; the driver holds the one it is at."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"),
                             F.col("text").cast("binary").alias("text")).where(
                                 "text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    n = 1 + int(size) // BLOCK_BYTES
    return n, ([(r["item"], bytes(r["text"])) for r in
                items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toLocalIterator()] for k in range(n))


def _merge_ranges(ranges: Column) -> Column:
    """Union of the word ranges of an array of _RANGES; touching ones joined."""
    def add(done: Column, new: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            last["first"].alias("first"), F.greatest(last["last"], new["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["end"], new["end"]).alias("end"))).cast(_RANGES))
        return (F.when(F.size(done) == 0, F.array(new).cast(_RANGES))
                 .when(last["last"] >= new["first"], joined)
                 .otherwise(F.concat(done, F.array(new).cast(_RANGES))))
    return F.aggregate(F.sort_array(ranges), F.array().cast(_RANGES), add)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS,
                       keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns, ``n_words``, ``hit`` (merged
    word ranges [first, last) covered by benchmark windows), ``spans`` (the same as
    byte ranges of the text) and ``items`` (sorted ids of the items found).

    Null or empty texts have no words. Items without words find nothing; those without
    an id are found like any other, but are not among ``items``; repeated items count
    once. An empty table on either side gives whole, unhit or no rows. Columns besides
    ``keep`` and ``text`` are not read. A benchmark of more than ``BLOCK_BYTES`` takes a
    pass for each block, whose hits are stored by the text's SHA-256 before the next
    block is read; ``keep`` may be of any type.
    """
    narrow = docs.select(*keep, F.col("text").cast("binary").alias(BODY))
    n, blocks = _blocks(benchmark) if benchmark is not None else (1, iter([[]]))
    if n == 1:
        return _find(narrow, next(blocks), width)
    digest = F.sha2(F.col(BODY), 256)
    found = None
    for block in blocks:
        hits = _find(narrow.select(digest.alias("_digest"), BODY), block, width).where(F.size("hit") > 0)
        part = store(hits.drop("n_words"), "block-hits")
        found = part if found is None else found.unionByName(part)
        del block  # before the next one is read
    both = F.zip_with("hit", "spans", lambda h, b: F.struct(
        h["first"].alias("first"), h["last"].alias("last"), b["first"].alias("start"), b["last"].alias("end")))
    merged = found.groupBy("_digest").agg(F.flatten(F.collect_set(both)).alias("_ranges"),
                                          F.flatten(F.collect_set("items")).alias("_items"))
    merged = merged.select("_digest", _merge_ranges(F.col("_ranges")).alias("_ranges"),
                           F.array_sort(F.array_distinct("_items")).alias("_items"))
    taken = narrow.select(F.struct(*keep).alias("_keep"), digest.alias("_digest"), BODY)
    rows = _find(taken, [], width).drop("hit", "spans", "items").join(merged, "_digest", "left")
    part = lambda a, b: F.coalesce(F.transform("_ranges", lambda r: F.struct(
        r[a].alias("first"), r[b].alias("last"))), F.array().cast(_SPAN))
    return rows.select(*[F.col(f"_keep.`{c}`").alias(c) for c in keep], "n_words", part("first", "last").alias("hit"),
                       part("start", "end").alias("spans"),
                       F.coalesce("_items", F.array().cast("array<string>")).alias("items"))


def n_hit() -> Column:
    """Words in the merged hit ranges."""
    return F.aggregate("hit", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without the byte ranges."""
    raw = text.cast("binary")
    start = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out"))
    kept = F.aggregate(spans, start, lambda s, x: F.struct(
        x["last"].alias("at"), F.concat(s["out"], F.substring(raw, s["at"] + 1, x["first"] - s["at"])).alias("out")))
    return F.concat(kept["out"], F.substring(raw, kept["at"] + 1, F.octet_length(raw))).cast("string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with the hit spans cut out of the text; rows without a hit are
    untouched, ``n_chars`` (if present) follows the text. Needs ``text``; all other
    columns pass through, whatever their names and types."""
    columns = docs.columns
    taken = docs.select(F.struct(*columns).alias("_doc"), F.col("text").alias("text"))
    found = find_contamination(taken, benchmark, width, keep=("_doc",))
    cut = F.when(F.size("spans") > 0, remove_spans(F.col("_doc.text"), F.col("spans"))).otherwise(F.col("_doc.text"))
    out = {"text": cut}
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        out["n_chars"] = F.when(F.size("spans") > 0, F.char_length(cut).cast(kind)).otherwise(F.col("_doc.n_chars"))
    return found.select(*[out.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in columns])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in an occurrence of a benchmark window."""
    prepare(spark)
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"), "hit", "spans")
