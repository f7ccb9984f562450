"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance 2r or less have a common neighbour at distance
r or less from both. So every distinct fingerprint emits all variants with up to r
flipped bits (65 for r = 1), the variants are shuffled, and fingerprints that meet
on a variant are checked and linked. A variant is met by at most as many
fingerprints as its ball holds (65), however large a group of copies is: equal
fingerprints are merged before the variants are made, and all that meet on a
variant are linked to the smallest of them, never all to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesoro.llm.common import prepare, read, steps, store, values
from tesoro.llm.components import connected_components

BITS = 64
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
HASH_SEED = 42

# Row b of the table: the bits of byte value b, lowest first.
_BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_OFFSETS = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: bytes | None, words_per_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; the whole word sequence when
    it is shorter than a shingle; empty without words. ``bytes.lower`` changes A-Z
    only and ``bytes.split`` cuts at the six ASCII white-space characters."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        hashes = [digest(b" ".join(words), HASH_SEED)] if words else []
        return np.array(hashes, dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    firsts = (ends - lengths)[: len(words) - words_per_shingle + 1].tolist()
    lasts = ends[words_per_shingle - 1:].tolist()
    joined = b" ".join(words)
    return np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(firsts, lasts)),
                       dtype=np.uint64, count=len(firsts))


def fingerprint(text: bytes | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash as a signed 64-bit number: bit i is 1 if it is set in over half
    the shingle hashes; 0 without words."""
    hashes = shingle_hashes(text, words_per_shingle)
    counts = np.zeros((8, 256), dtype=np.int64)
    for first in range(0, len(hashes), 1 << 16):  # bounds the index array of a very long text
        part = hashes[first:first + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((part + _BYTE_OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _BIT_TABLE).ravel() * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      words_per_shingle: int = SHINGLE_WORDS, hashed: bool = False) -> DataFrame:
    """``(doc_id, fp)`` of every row, with ``hashed`` also ``text_hash``, which tells texts
    apart; null texts have no words."""
    more = [F.xxhash64(text_col).alias("text_hash")] if hashed else []
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), *more,
                         F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            fps = [fingerprint(t, words_per_shingle) for t in values(step, "text")]
            yield pa.RecordBatch.from_arrays([*step.columns[:-1], pa.array(fps, pa.int64())],
                                             [*step.schema.names[:-1], "fp"])

    return narrow.mapInArrow(run, "doc_id long, text_hash long, fp long" if hashed else "doc_id long, fp long")


def ball_masks(radius: int) -> list[int]:
    """All masks of up to ``radius`` set bits, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links ``(u, v)``, u < v, between the distinct fingerprints of ``fps`` (one
    ``fp`` column, no repeats). Every pair at ``max_distance`` or less is connected
    by links, and every link is at ``max_distance`` or less.

    ``max_distance`` must be even: half of it is the radius of the balls.
    """
    if max_distance % 2 or max_distance < 0:
        raise ValueError("max_distance must be even: half of it is the radius of the emitted balls")
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(max_distance // 2)])
    variants = fps.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("u", F.min("fp").over(Window.partitionBy("variant")))
    return (met.where(F.col("u") != F.col("fp"))
               .where(F.bit_count(F.col("u").bitwiseXOR(F.col("fp"))) <= max_distance)
               .select("u", F.col("fp").alias("v")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words_per_shingle: int = SHINGLE_WORDS,
                    max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id`` (smallest id reachable
    over links, itself included).

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows give repeated result rows. A null id is kept; it is never a component's id
    unless the component has no other. An empty table gives an empty result. Other
    columns are not read, so their names can't clash.
    """
    return _components(docs, id_col, text_col, words_per_shingle, max_distance).select("doc_id", "fp", "component_id")


def _components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE_WORDS,
                max_distance: int = MAX_DISTANCE, hashed: bool = False) -> DataFrame:
    """``near_duplicates`` with the components' ``root``, which alone tells them apart when
    ids are null or repeated, and with ``text_hash`` if ``hashed``."""
    marked = store(with_fingerprints(docs, id_col, text_col, words_per_shingle, hashed), "fingerprints")
    by_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    roots = connected_components(links(by_fp.select("fp"), max_distance))
    rooted = (by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                   .select("fp", "smallest", F.coalesce("root", "fp").alias("root")))
    # at most one row per distinct fingerprint on either side
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    component = rooted.join(smallest, "root").select("fp", "root", "component_id")
    # a hot fingerprint is split by the adaptive skew join: only documents repeat it
    return marked.join(component, "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group, one of each: the row whose id
    (``id_col``) is the component's id; of several texts with that id, that of the smallest
    fingerprint, then hash; of rows that agree in id and text, the first in the
    order of the other columns. A row without an id stays only for a group in which no
    row has one."""
    kept = (_components(docs, id_col=id_col, text_col=text_col, **options, hashed=True)
            .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("fp", "text_hash")).alias("of"))
            .select(F.coalesce("doc_id", F.lit(-1)).alias("_key"), F.col("doc_id").isNull().alias("_none"),
                    F.col("of.text_hash").alias("_text")))
    key = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                       F.xxhash64(F.col(f"`{text_col}`")).alias("_text"), F.coalesce(key, F.lit(-1)).alias("_key"),
                       key.isNull().alias("_none"))
    first = Window.partitionBy("_key", "_none", "_text").orderBy(
        *[F.col(f"_doc.`{c}`") for c, kind in docs.dtypes if c not in (id_col, text_col) and "map" not in kind],
        F.lit(0))
    return (rows.join(kept, ["_key", "_none", "_text"], "left_semi")
                .withColumn("_n", F.row_number().over(first)).where("_n = 1")
                .select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of every document (3-word shingles, 2 bits or fewer)."""
    prepare(spark)
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
