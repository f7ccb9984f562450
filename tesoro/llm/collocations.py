"""Phrase collocations by dynamic itemset counting.

The corpus is cut into words once and stored in ``INTERVALS`` slices that are scanned one after the other, round
and round. Words are counted from the first slice on. As soon as both subphrases of a
longer phrase (without its last and without its first word) have reached the threshold,
the phrase becomes active with the next slice, whichever that is, and is counted until
it has seen each slice once. So the lengths are counted interleaved; the scans end when
the last active phrase has completed its cycle.

Counters are kept under 64-bit keys in parts of the key space, as files of the shared
folder. A scanning task counts what it sees and passes packed blocks on by part, one task
a part adds them up, and the next scan looks up in the mapped files which phrases have
reached the threshold, and when. Which slices count for a phrase follows from the steps
in which its subphrases reached the threshold, so phrases that share a key don't disturb
each other: their counter only shows too much. A last scan names the keys that reached
the threshold and counts anew; the smaller of both figures is exact.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesoro.llm.common import (MapCache, mounted_path, prepare, read, shared_uri, shuffles_go, steps, store, values,
                               write_file)
from tesoro.llm.hash_arrays import BLOCK, Held, bits_for, merged, top_part, unblock

INTERVALS = 4
MAX_WORDS = 5
# Text bytes whose counters one task holds, and fewest parts.
PART_BYTES = 16 << 20
LEAST_PARTS = 16
# Text bytes of a stored chunk, and phrases that a task names before it passes them on.
CHUNK_BYTES = 4 << 20
NAMED = 1 << 19
NEVER = np.int64(1 << 40)

# A-Z in lower case, tab as space, and the ends of pieces as a byte that no UTF-8 text has.
_END = 0xFF
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else _END if 10 <= b <= 13 or b in b".,;:!?" else b
               for b in range(256))
CHUNKS = "lang string, n_bytes long, wide boolean, numbers binary, hashes binary, words binary"
_STRETCH = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# The bits of a phrase's hash that are in its key; the other three are its length.
KEY_BITS = (1 << 64) - 8


def encoded(lang: str, texts: list[bytes]) -> dict:
    """Texts of a lang as word numbers (0: the end of a piece), and the hashes and the
    words that the numbers from 1 on stand for."""
    data = b"\xff".join(texts).translate(_TABLE).replace(b"\xff", b" \xff ").split()
    known = {b"\xff": 0}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in data), dtype="<u4", count=len(data))
    words = list(known)[1:]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype="<u8", count=len(words))
    kind = "<u2" if len(known) < 1 << 16 else "<u4"
    return {"lang": lang, "n_bytes": sum(map(len, texts)), "wide": kind == "<u4",
            "numbers": numbers.astype(kind).tobytes(), "hashes": hashes.tobytes(), "words": b" ".join(words)}


def _encode(rows: DataFrame) -> DataFrame:
    """``rows`` (``lang``, ``text``) in chunks of some megabytes of a lang's text."""
    kind = pa.schema([("lang", pa.string()), ("n_bytes", pa.int64()), ("wide", pa.bool_()),
                      ("numbers", pa.binary()), ("hashes", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        total = 0
        for batch in steps(batches, "text"):
            for lang, text in zip(values(batch, "lang"), values(batch, "text")):
                held.setdefault(lang, []).append(text or b"")
                sizes[lang] = sizes.get(lang, 0) + len(text or b"")
                total += len(text or b"")
            # the largest of them, so that what is held is bounded for any number of langs
            for lang in sorted(sizes, key=sizes.get, reverse=True):
                if sizes[lang] < CHUNK_BYTES and total < 4 * CHUNK_BYTES:
                    break
                total -= sizes.pop(lang)
                yield pa.RecordBatch.from_pylist([encoded(lang, held.pop(lang))], kind)
        for lang, texts in held.items():
            yield pa.RecordBatch.from_pylist([encoded(lang, texts)], kind)

    return rows.mapInArrow(run, CHUNKS)


class Reached:
    """The steps in which keys reached the threshold, in files ``reached-STEP-PART``:
    sorted keys, then steps."""

    def __init__(self, folder: str, step: int, bits: int, key_bits: int = KEY_BITS):
        self.folder, self.step, self.bits, self.key_bits = folder, step, bits, np.uint64(key_bits)
        self.maps = MapCache("<u8")
        self._heads: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return {**self.__dict__, "_heads": {}}

    def _part(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
        """Keys, steps, and where the keys of each range of the next bits begin."""
        data = self.maps[os.path.join(self.folder, f"reached-{self.step}-{part}")]
        n = len(data) // 2
        bits = max(1, bits_for(n))
        if part not in self._heads:
            if len(self._heads) >= self.maps.limit:
                self._heads.clear()
            range_ = ((data[:n] << np.uint64(self.bits)) >> np.uint64(64 - bits)).astype(np.int64)
            self._heads[part] = np.cumsum(np.bincount(range_ + 1, minlength=(1 << bits) + 1))
        return data[:n], data[n:], self._heads[part], np.uint64(64 - bits)

    def steps(self, keys: np.ndarray) -> np.ndarray:
        """The step of each key; NEVER if it hasn't reached the threshold."""
        out = np.full(len(keys), NEVER)
        if self.step < 0 or not len(keys):
            return out
        part = top_part(self.bits)(keys)
        order = np.argsort(part.astype(np.uint16 if self.bits <= 16 else np.uint32), kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=1))
        for p in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            rows = order[ends[p - 1] if p else 0:ends[p]]
            held, step, heads, shift = self._part(p)
            if not len(held):
                continue
            wanted = keys[rows]
            range_ = ((wanted << np.uint64(self.bits)) >> shift).astype(np.int64)
            at, end = heads[range_], heads[range_ + 1]
            live = np.flatnonzero(at < end)
            while len(live):  # a range has about one key
                place = at[live]
                same = held[place] == wanted[live]
                out[rows[live[same]]] = step[place[same]].astype(np.int64)
                at[live] += 1
                live = live[~same & (place + 1 < end[live])]
        return out


class Chunk:
    """A chunk's words with their keys; words that occur in it are looked up once."""

    def __init__(self, row: dict, reached: Reached):
        self.lang, self.reached = row["lang"], reached
        self.numbers = np.frombuffer(row["numbers"], "<u4" if row["wide"] else "<u2").astype(np.int64)
        seed = np.uint64(xxhash.xxh3_64_intdigest(self.lang))
        self.single = _mixed(np.r_[np.uint64(0), np.frombuffer(row["hashes"], "<u8")] ^ seed)
        self.keys = (self.single & reached.key_bits) | np.uint64(1)
        self.steps = reached.steps(self.keys)
        self.steps[0] = NEVER  # the end of a piece

    def longer(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length from 2 on: ``(size, places, keys, active, own)`` of the phrases
        whose subphrases have reached the threshold; ``active`` is the step in which a
        phrase becomes active, ``own`` the one in which it reached the threshold itself."""
        own = self.steps[self.numbers]
        at = np.flatnonzero(own < NEVER)
        own, raw = own[at], self.single[self.numbers[at]]
        for size in range(2, MAX_WORDS + 1):
            follows = np.flatnonzero(at[1:] == at[:-1] + 1)
            active = np.maximum(own[follows], own[follows + 1]) + 1
            at = at[follows]
            raw = _mixed(raw[follows] * _STRETCH + self.single[self.numbers[at + size - 1]])
            keys = (raw & self.reached.key_bits) | np.uint64(size)
            own = self.reached.steps(keys)
            yield size, at, keys, active, own
            live = own < NEVER
            at, raw, own = at[live], raw[live], own[live]


def _scan(slice_: DataFrame, reached: Reached, step: int, intervals: int) -> DataFrame:
    """Counts of the phrases that are active in this step, as blocks by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(top_part(reached.bits))
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, reached)
                if step < intervals:
                    times = np.bincount(chunk.numbers, minlength=1)
                    yield from held.put(chunk.keys[1:], times[1:])
                for _, _, keys, active, _ in chunk.longer():
                    counting = step < active + intervals
                    if counting.any():
                        yield from held.add(keys[counting])
        yield from held.flush()
    return slice_.select("lang", "wide", "numbers", "hashes").mapInArrow(run, BLOCK)


def _add(blocks: DataFrame, folder: str, bits: int, step: int, intervals: int, threshold: int) -> int:
    """Add a step's blocks to the counters. Returns how many phrases below the full
    length have reached the threshold in this step."""
    def read_file(name: str, part: int, *kinds: str) -> list[np.ndarray]:
        """The columns of a file, one after the other."""
        path = os.path.join(folder, f"{name}-{step - 1}-{part}")
        data = np.fromfile(path, np.uint8) if os.path.exists(path) else np.zeros(0, np.uint8)
        widths = [np.dtype(k).itemsize for k in kinds]
        ends = np.cumsum(widths) * (len(data) // sum(widths))
        return [data[b - a:b].view(k) for a, b, k in zip(np.diff(ends, prepend=0), ends, kinds)]

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        new, more = unblock(table)
        keys, counts, first = read_file("open", part, "<u8", "<u4", "<u2")  # counts are below the threshold
        done, done_step = read_file("reached", part, "<u8", "<u8")
        done_count, = read_file("counts", part, "<u8")
        if len(done):
            place = np.minimum(np.searchsorted(done, new), len(done) - 1)
            old = done[place] == new
            done_count = done_count.copy()
            done_count[place[old]] += more[old].astype(np.uint64)
            new, more = new[~old], more[~old]
        both, count = merged([keys, new], [counts.astype(np.int64), more])
        since = np.full(len(both), step, dtype="<u2")
        since[np.searchsorted(both, keys)] = first
        now = count >= threshold
        done = np.r_[done, both[now]]
        done_step = np.r_[done_step, np.full(int(now.sum()), step, dtype=np.uint64)]
        done_count = np.r_[done_count, count[now].astype(np.uint64)]
        order = np.argsort(done)
        live = ~now & (since.astype(np.int64) + intervals - 1 > step)  # the others have completed their cycle
        out = lambda name, *columns: write_file(
            os.path.join(folder, f"{name}-{step}-{part}"), *(c.tobytes() for c in columns))
        out("open", both[live], count[live].astype("<u4"), since[live])
        out("reached", done[order], done_step[order])
        out("counts", done_count[order])
        longer = int(np.count_nonzero((both[now] & np.uint64(7)) < MAX_WORDS))
        return pa.table({"n": pa.array([longer], pa.int64())})

    none = blocks.sparkSession.range(1 << bits).selectExpr("int(id) part", "binary('') once", "binary('') more",
                                                           "binary('') counts")
    # more partitions than parts, so that parts don't pile up in a task
    return blocks.unionByName(none).repartition(2 << bits, "part").groupBy("part").applyInArrow(run, "n long").agg(F.sum("n")).first()[0]


def _remove(folder: str, step: int, bits: int) -> None:
    """Counters of an earlier step: no later one reads them."""
    for part in range(1 << bits):
        for name in ("open", "reached", "counts"):
            path = os.path.join(folder, f"{name}-{step}-{part}")
            if os.path.exists(path):
                os.remove(path)


_NAMES = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("size", pa.int32()), ("key", pa.uint64()),
                    ("c", pa.int64())])


def _names(batches: Iterator[pa.RecordBatch], reached: Reached) -> Iterator[pa.RecordBatch]:
    """What the phrases that reached the threshold are called and how often the task sees
    them, and the number of words of each lang as phrase '' of size 0: a block for each
    part, an Arrow stream of ``_NAMES`` rows."""
    held: list[pa.Table] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        table = _summed(pa.concat_tables(held))
        part = top_part(reached.bits)(table["key"].to_numpy())
        order = np.argsort(part, kind="stable")
        table, part = table.take(order), part[order]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _NAMES) as out:
                out.write_table(table.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([sink.getvalue().to_pybytes()])],
                                             ["part", "block"])

    for batch in batches:
        for row in batch.to_pylist():
            chunk = Chunk(row, reached)
            words = [b"", *row["words"].split(b" ")] if row["words"] else [b""]
            times = np.bincount(chunk.numbers, minlength=1)
            found = np.flatnonzero(chunk.steps < NEVER)
            phrases, sizes = [b"", *(words[i] for i in found.tolist())], [np.r_[0, np.ones(len(found), int)]]
            keys, counts = [np.r_[np.uint64(0), chunk.keys[found]]], [np.r_[times[1:].sum(), times[found]]]
            for n, at, key, _, own in chunk.longer():
                at, key = at[own < NEVER], key[own < NEVER]
                if not len(at):
                    break
                order = np.argsort(key, kind="stable")
                key, grams = key[order], np.stack([chunk.numbers[at[order] + i] for i in range(n)], axis=1)
                other = (grams[1:] != grams[:-1]).any(axis=1)
                if (other & (key[1:] == key[:-1])).any():  # phrases that share a key
                    order = np.lexsort((*grams.T, key))
                    key, grams = key[order], grams[order]
                    other = (grams[1:] != grams[:-1]).any(axis=1)
                first = np.flatnonzero(np.r_[True, other | (key[1:] != key[:-1])])
                phrases += [b" ".join([words[w] for w in g]) for g in grams[first].tolist()]
                sizes.append(np.full(len(first), n))
                keys.append(key[first])
                counts.append(np.diff(np.r_[first, len(key)]))
            held.append(pa.Table.from_arrays(
                [pa.array([chunk.lang] * len(phrases)), pa.array(phrases, pa.binary()),
                 pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(keys), pa.uint64()),
                 pa.array(np.concatenate(counts), pa.int64())], schema=_NAMES))
            size += len(phrases)
            if size > NAMED:
                held = [_summed(pa.concat_tables(held))]
                size = held[0].num_rows
                if size > NAMED // 2:
                    yield from flush()
                    held, size = [], 0
    if held:
        yield from flush()


def _summed(table: pa.Table) -> pa.Table:
    """One row for each phrase."""
    out = table.group_by(["lang", "phrase", "size", "key"], use_threads=False).aggregate([("c", "sum")])
    return out.rename_columns(["lang", "phrase", "size", "key", "c"]).select(_NAMES.names).cast(_NAMES)


def _named(corpus: DataFrame, reached: Reached, threshold: int) -> DataFrame:
    """``lang, phrase, size, f`` of the phrases that occur often enough: the counter, or
    the number of times that the phrase was seen where its counter counts another too."""
    def total(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        rows = _summed(pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["block"]]))
        name = lambda kind: os.path.join(reached.folder, f"{kind}-{reached.step}-{part}")
        keys, counts = np.fromfile(name("reached"), "<u8").reshape(2, -1)[0], np.fromfile(name("counts"), "<i8")
        size, key, seen = (rows[c].to_numpy() for c in ("size", "key", "c"))
        f = seen.copy()
        if len(keys):
            counter = counts[np.minimum(np.searchsorted(keys, key), len(keys) - 1)]
            f[size > 0] = np.minimum(seen, counter)[size > 0]
        rows = rows.select(["lang", "phrase", "size"]).append_column("f", pa.array(f, pa.int64()))
        rows = rows.set_column(1, "phrase", rows["phrase"].cast(pa.string()))
        return rows.filter(pa.array((size == 0) | (f >= threshold)))

    blocks = corpus.select("lang", "wide", "numbers", "hashes", "words").mapInArrow(
        lambda batches: _names(batches, reached), "part int, block binary")
    return blocks.repartition(2 << reached.bits, "part").groupBy("part").applyInArrow(total, "lang string, phrase string, size int, f long")


def frequent_phrases(docs: DataFrame, threshold: int = 100, intervals: int = INTERVALS,
                      key_bits: int = KEY_BITS) -> DataFrame:
    """``lang, phrase, size, f`` of all phrases of 1 to ``MAX_WORDS`` words that occur at
    least ``threshold`` times in their lang's texts, and the number of words of each lang
    as phrase '' of size 0. Stored.

    Reads ``lang`` and ``text``. Null texts are empty, a null lang is ``und``; repeated
    rows count as often as they are there; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = mounted_path(shared_uri(spark, "collocations"))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("binary").alias("text"))
    uri = shared_uri(spark, "collocation-slices")
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(intervals))
    _encode(rows).withColumn("slice", dealt.cast("int")).write.partitionBy("slice").parquet(uri, compression="zstd")
    corpus = spark.read.schema(f"{CHUNKS}, slice int").parquet(uri)
    size = corpus.agg(F.sum("n_bytes")).first()[0] or 0
    bits = bits_for(max(LEAST_PARTS, int(size) // PART_BYTES))
    step = last = 0
    while True:
        reached = Reached(folder, step - 1, bits, key_bits)
        turn = corpus.where(F.col("slice") == step % intervals)
        with shuffles_go(spark):
            if _add(_scan(turn, reached, step, intervals), folder, bits, step, intervals, threshold):
                last = step
        if step:
            _remove(folder, step - 1, bits)
        if step >= last + intervals:
            break
        step += 1
    return store(_named(corpus, Reached(folder, step, bits, key_bits), threshold), "frequent-phrases")


def collocations(docs: DataFrame, threshold: int = 100, top: int = 2000, intervals: int = INTERVALS) -> DataFrame:
    """The ``top`` collocations of each lang: ``lang, rank, phrase, a, l, r, n, score``.

    A candidate is a phrase of 2 to 5 words that occurs ``a >= threshold`` times; its score
    is the least over its cuts into two parts (the first cut among equals) of
    ``floor(1000 a n / (l r))``. A candidate that lies inside a longer one which occurs as
    often is left out: it is enough to look at those one word longer, as what lies between
    two phrases of equal count has that count too. Products are exact decimals. Ties go by
    count, then by the phrase's bytes.
    """
    found = frequent_phrases(docs, threshold, intervals)
    words = found.where("size = 0").select("lang", F.col("f").alias("n"))
    parts = found.where("size BETWEEN 1 AND 4").select("lang", "phrase", "f")
    longer = found.where("size >= 2").withColumn("words", F.split("phrase", " "))
    inside = F.explode(F.array(F.expr("slice(words, 1, size - 1)"), F.expr("slice(words, 2, size - 1)")))
    covered = (longer.where("size > 2").select("lang", inside.alias("words"), F.col("f").alias("a"))
               .select("lang", F.array_join("words", " ").alias("phrase"), "a").distinct())
    kept = longer.withColumnRenamed("f", "a").join(covered, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("cut"), "words").select(
        "lang", "phrase", "a", "cut", F.array_join(F.expr("slice(words, 1, cut)"), " ").alias("head"),
        F.array_join(F.expr("slice(words, cut + 1, size(words))"), " ").alias("rest"))
    part = lambda name, f: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    score = F.expr("(cast(a AS decimal(18)) * cast(n AS decimal(17)) * cast(1000 AS decimal(4)))"
                   " div (cast(l AS decimal(18)) * cast(r AS decimal(18)))")
    scored = (cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
              .join(words, "lang").withColumn("score", score))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each lang of the documents."""
    prepare(spark)
    return collocations(read(spark, sf_dir, "documents"))


# The same with every phrase of every length counted.
OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT unnest(range(1, 6)) AS k),
grams AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
          FROM w, sizes WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2),
inside AS (
    SELECT DISTINCT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase
    FROM (SELECT lang, a, w, s, unnest(range(1, k - s + 2)) AS i
          FROM (SELECT lang, a, w, k, unnest(range(2, k)) AS s FROM c))),
kept AS (SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM inside x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 100 * c.a)),
cuts AS (SELECT lang, phrase, w, a, k, unnest(range(1, k)) AS cut FROM kept),
scored AS (
    SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, n,
           CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ')
              JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:cuts.k], ' ')
              JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank,
       phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
