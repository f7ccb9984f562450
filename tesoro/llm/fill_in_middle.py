"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME_BYTES`` raw bytes
each, one document after the other in a file of the shared folder. The index, a table
with a row for each document, has the file, the place, the frames' sizes and the number
of units and code points up to the end of each frame. So a cut after so many units is
found by a search of the cumulative counts and the decompression of one frame, and
outputs and digests stream the frames in the order in which the output has them: no step
holds more than a frame of a text.

A unit is a word with the white space before it; white space at the end is one more.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tesoro.llm.common import mounted_path, prepare, read, shared_uri, steps, store, values

FRAME_BYTES = 64 << 10
# Raw text bytes of a task that reads frames, and of a stretch of a file that stays together.
TASK_BYTES = 32 << 20
STRETCH_BYTES = 4 << 20

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_SPACE = bytes(b == 32 or 9 <= b <= 13 for b in range(256))
_INDEX = ("doc_id {id}, path string, at long, n_bytes long, marked boolean, sizes array<int>, "
          "units array<long>, chars array<long>")
_FORMS = ("prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def inner_ends(data: bytes) -> np.ndarray:
    """Ends of units inside ``data``: a byte that isn't white space before one that is."""
    space = np.frombuffer(data.translate(_SPACE), dtype=np.int8)
    return np.flatnonzero(space[1:] > space[:-1]) + 1


def code_points(data: bytes) -> int:
    """Code points whose first byte is in ``data``."""
    return int(np.count_nonzero(np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80))


def split(text: bytes, size: int = FRAME_BYTES) -> Iterator[tuple[bytes, int, int]]:
    """``(raw bytes, unit ends, code points)`` of the frames of a text. The end of the
    text closes a unit; the empty text has no frame."""
    for at in range(0, len(text), size):
        data = text[at:at + size]
        closed = at + size >= len(text) or not _SPACE[data[-1]] and _SPACE[text[at + size]]
        yield data, len(inner_ends(data)) + bool(closed), code_points(data)


class Frames:
    """The stored text of a document."""

    def __init__(self, file, row: dict):
        self.file, self.at, self.n_bytes = file, row["at"], row["n_bytes"]
        self.sizes, self.units, self.chars = row["sizes"], row["units"], row["chars"]
        self.places = np.r_[0, np.cumsum(self.sizes, dtype=np.int64)].tolist()
        self.size = row["frame_bytes"]
        self.frame = lru_cache(maxsize=2)(self._frame)  # both cuts are often in one frame

    def _frame(self, number: int) -> bytes:
        self.file.seek(self.at + self.places[number])
        return zstandard.ZstdDecompressor().decompress(self.file.read(self.sizes[number]))

    def cut(self, unit: int) -> tuple[int, int]:
        """Bytes and code points of the first ``unit`` units."""
        if unit == 0:
            return 0, 0
        number = bisect_left(self.units, unit)
        data = self.frame(number)
        nth = unit - (self.units[number - 1] if number else 0)
        ends = inner_ends(data)
        end = int(ends[nth - 1]) if nth <= len(ends) else len(data)
        return (number * self.size + end,
                (self.chars[number - 1] if number else 0) + code_points(data[:end]))

    def stream(self, first: int, last: int) -> Iterator[bytes]:
        """The bytes [first, last), frame by frame."""
        while first < last:
            number, skip = divmod(first, self.size)
            piece = self.frame(number)[skip:skip + last - first]
            yield piece
            first += len(piece)


class Output:
    """The output as a row of markers and ranges of the text."""

    def __init__(self, text: Frames, form: str, first: int, last: int):
        prefix, middle, suffix = (0, first), (first, last), (last, text.n_bytes)
        self.text, self.form = text, form
        self.pieces = {"plain": [(0, text.n_bytes)],
                       "psm": [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle],
                       "spm": [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]}[form]

    def stream(self, first: int = 0, last: int | None = None) -> Iterator[bytes]:
        """The bytes [first, last) of the output."""
        at = 0
        for piece in self.pieces:
            size = len(piece) if isinstance(piece, bytes) else piece[1] - piece[0]
            a, b = max(0, first - at), size if last is None else min(size, last - at)
            if a < b:
                if isinstance(piece, bytes):
                    yield piece[a:b]
                else:
                    yield from self.text.stream(piece[0] + a, piece[0] + b)
            at += size


def restored(stream: Callable[..., Iterator[bytes]], form: str) -> Iterator[bytes]:
    """The text rebuilt from an output and its form alone: a first pass over the output
    finds the markers, a second one streams what is between them in text order."""
    if form == "plain":
        yield from stream()
        return
    found, done, tail = {}, 0, b""
    for piece in stream():
        data = tail + piece
        for marker in (PREFIX, SUFFIX, MIDDLE):
            at = data.find(marker)
            if at >= 0 and marker not in found:
                found[marker] = done + at
        tail = data[-2:]
        done += len(data) - len(tail)
    end = done + len(tail)
    after = sorted([*found.values(), end])
    for marker in (PREFIX, MIDDLE, SUFFIX):
        first = found[marker]
        yield from stream(first + len(marker), after[after.index(first) + 1])


def _digest(pieces: Iterator[bytes]) -> str:
    out = hashlib.sha256()
    for piece in pieces:
        out.update(piece)
    return out.hexdigest()


def write_frames(docs: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Store the texts of ``docs`` (``doc_id``, ``text``) as frames in files below
    ``folder``, a URI on a store that all workers mount. Returns the index, stored:
    ``doc_id``, file and place, ``n_bytes``, ``marked`` (the text has a marker), and of
    each frame its compressed size and the units and code points up to its end.

    A task writes a file under a name of its own; the index has the files of the tasks
    that succeeded. Null texts are empty; an empty text has no frame. All rows are kept,
    repeated ones too.
    """
    target = mounted_path(folder)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(target, exist_ok=True)
        path = os.path.join(target, f"frames-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}")
        zipped, at = zstandard.ZstdCompressor(level=3), 0
        with open(path, "wb") as file:
            for batch in steps(batches, "text"):
                rows = []
                for text in values(batch, "text"):
                    text = text or b""
                    row = {"at": at, "n_bytes": len(text), "marked": any(m in text for m in (PREFIX, SUFFIX, MIDDLE)),
                           "sizes": [], "units": [], "chars": []}
                    units = chars = 0
                    for data, ends, points in split(text, frame_bytes):
                        units, chars, frame = units + ends, chars + points, zipped.compress(data)
                        file.write(frame)
                        at += len(frame)
                        row["sizes"].append(len(frame))
                        row["units"].append(units)
                        row["chars"].append(chars)
                    rows.append(row)
                column = lambda name, kind: pa.array([r[name] for r in rows], kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([path] * len(rows)), column("at", pa.int64()),
                     column("n_bytes", pa.int64()), column("marked", pa.bool_()),
                     column("sizes", pa.list_(pa.int32())), column("units", pa.list_(pa.int64())),
                     column("chars", pa.list_(pa.int64()))],
                    ["doc_id", "path", "at", "n_bytes", "marked", "sizes", "units", "chars"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    written = rows.mapInArrow(run, _INDEX.format(id=kind.simpleString()))
    return store(written.withColumn("frame_bytes", F.lit(frame_bytes)), "frame-index")


def _draw(seed: int, group: int) -> Column:
    """Group ``group`` of 8 hex digits of the sha256 of ``seed:doc_id``; a null id is the
    empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * group, 8), 16, 10).cast("long")


def plan_cuts(index: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """The index with ``n`` (units), ``first`` and ``last`` (units before the middle and
    before the suffix) and ``form``; the texts aren't read."""
    n = F.when(F.size("units") > 0, F.element_at("units", -1)).otherwise(0).cast("long")
    cuts = [F.pmod(_draw(seed, i), n + 1) for i in (0, 1)]
    plain = (F.col("n_bytes") == 0) | F.col("marked") | (F.pmod(_draw(seed, 2), F.lit(100)) >= fim_percent)
    return index.select("*", n.alias("n"), F.least(*cuts).alias("first"), F.greatest(*cuts).alias("last"),
                        F.when(plain, "plain").when(F.pmod(_draw(seed, 3), F.lit(100)) < spm_percent, "spm")
                         .otherwise("psm").alias("form"))


def _transformed(planned: DataFrame, keep_output: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    if file:
                        file.close()
                    path = row["path"]
                    file = open(path, "rb")  # noqa: SIM115  closed when the next one opens
                text = Frames(file, row)
                plain = row["form"] == "plain"
                (a, before), (b, upto) = ((0, 0), (0, 0)) if plain else (text.cut(row["first"]), text.cut(row["last"]))
                output = Output(text, row["form"], a, b)
                rows.append({"doc_id": row["doc_id"], "n": row["n"], "form": row["form"],
                             "prefix_chars": None if plain else before, "middle_chars": None if plain else upto - before,
                             "output_sha256": _digest(output.stream()),
                             "restored_sha256": _digest(restored(output.stream, row["form"]))})
                if keep_output:
                    rows[-1]["output"] = b"".join(output.stream()).decode()
                if keep_output and sum(len(r["output"]) for r in rows) > TASK_BYTES // 4:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if file:
            file.close()

    kind = planned.schema["doc_id"].dataType
    out = f"doc_id {kind.simpleString()}, n long, form string, {_FORMS}" + ", output string" * keep_output
    schema = to_arrow_schema(StructType.fromDDL(out))
    return planned.mapInArrow(run, out)


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80,
                   keep_output: bool = False, folder: str | None = None,
                   frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per row of ``docs`` (``doc_id`` of any simple type, ``text``): ``n`` units,
    ``form`` (plain, psm: prefix, suffix, middle; spm: suffix, prefix, middle),
    ``prefix_chars`` and ``middle_chars`` (null if plain), digests of the output and of
    the text rebuilt from it, and the ``output`` itself if asked for.

    The draws depend on the seed and the id alone, so repeated rows come out alike and a
    retried task gives the same; a null id draws like the empty string. A null text is the
    empty text, which is plain like every text that holds a marker. Cuts fall between
    units, so never inside a character. Very long texts take as many frames as they need.
    Columns besides ``doc_id`` and ``text`` are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    index = write_frames(docs, folder or shared_uri(spark, "frames"), frame_bytes)
    total = index.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, int(total) // TASK_BYTES)
    stretch = (F.col("at") / STRETCH_BYTES).cast("long")
    planned = (plan_cuts(index, seed, fim_percent, spm_percent)
               .repartition(tasks, "path", stretch).sortWithinPartitions("path", "at"))
    return _transformed(planned, keep_output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cut places and digests of the transformation of every document."""
    prepare(spark)
    return fill_in_middle(read(spark, sf_dir, "documents"))


# The same with whole texts in lists of units.
OP13_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
           sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
e AS (
    SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
           CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM d),
f AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM e),
g AS (
    SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
           coalesce(array_to_string(units[b + 1:n], ''), '') AS s
    FROM f)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM g
"""
