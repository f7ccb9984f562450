"""Language identification of mixed-language text.

Each word is scored in every language by its byte trigrams; the scripts of its letters
narrow the candidates; Viterbi with a switching penalty labels spans of words. A text's
language is the one whose spans hold most letter bytes.

Training counts trigrams and scripts in Spark over all training rows; what reaches the
driver is one number for each language and bucket, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesoro.llm.common import BODY, prepare, read, steps, values

BUCKETS = 1 << 16
SMOOTHING = 0.5
# Cost of a change of language between two words, in nats.
SWITCH_PENALTY = 20.0
# A script is possible in a language if so large a share of its training words have it.
SCRIPT_SHARE = 1e-3
# Letter positions scored at a time.
POSITIONS = 1 << 21
UNDETERMINED = "und"

# A-Z in lower case; letters and all bytes of other characters stay; the rest separates.
LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Code point ranges of the scripts told apart; what is in none of them (Latin letters,
# marks, punctuation) narrows nothing.
SCRIPT_RANGES = (
    (0x0370, 0x03FF), (0x1F00, 0x1FFF),  # Greek
    (0x0400, 0x052F),                    # Cyrillic
    (0x0530, 0x058F),                    # Armenian
    (0x0590, 0x05FF),                    # Hebrew
    (0x0600, 0x077F),                    # Arabic
    (0x0900, 0x097F),                    # Devanagari
    (0x0980, 0x0DFF),                    # other Indic
    (0x0E00, 0x0EFF),                    # Thai, Lao
    (0x10A0, 0x10FF),                    # Georgian
    (0x1100, 0x11FF), (0xAC00, 0xD7FF),  # Hangul
    (0x3040, 0x30FF),                    # Kana
    (0x3400, 0x9FFF),                    # Han
)


def _script_table() -> np.ndarray:
    """Script bit by the first two bytes of a UTF-8 character: exact for two-byte
    characters, by the block's first code point for longer ones."""
    table = np.zeros(1 << 16, dtype=np.uint16)
    for lead in range(0xC2, 0xF5):
        for second in range(0x80, 0xC0):
            point = ((lead & 0x1F) << 6 | (second & 0x3F) if lead < 0xE0 else
                     (lead & 0x0F) << 12 | (second & 0x3F) << 6 if lead < 0xF0 else
                     (lead & 0x07) << 18 | (second & 0x3F) << 12)
            for bit, (a, b) in enumerate(SCRIPT_RANGES):
                if a <= point <= b:
                    table[lead << 8 | second] = 1 << bit
    return table


_SCRIPTS = _script_table()


@dataclass
class Words:
    """Words of a run of texts, joined in one byte array."""
    letters: np.ndarray  # positions of all letter bytes
    starts: np.ndarray   # index in ``letters`` of each word's first
    owner: np.ndarray    # text of each word
    bytes: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(np.r_[self.starts, len(self.letters)])


def split_words(texts: list[bytes | None]) -> Words:
    joined = b" " + b" ".join((t or b"").translate(LETTER_BYTES) for t in texts) + b"  "
    data = np.frombuffer(joined, dtype=np.uint8)
    is_letter = data != 32
    letters = np.flatnonzero(is_letter)
    starts = np.flatnonzero(~is_letter[letters - 1])
    ends = np.cumsum([len(t or b"") + 1 for t in texts])  # after each text's separator
    owner = np.searchsorted(ends, letters[starts] - 1, side="right")
    return Words(letters, starts, owner, data)


def trigram_buckets(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash bucket of the three bytes around each position; words end in spaces."""
    mixed = (data[at - 1].astype(np.uint32) << np.uint32(16)) | (data[at].astype(np.uint32) << np.uint32(8)) | data[at + 1]
    return ((mixed * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def word_scripts(words: Words) -> np.ndarray:
    """Bits of the scripts that each word has letters of."""
    if not len(words.starts):
        return np.zeros(0, dtype=np.uint16)
    first = words.bytes[words.letters].astype(np.uint16)
    bits = _SCRIPTS[(first << np.uint16(8)) | words.bytes[words.letters + 1]]
    return np.bitwise_or.reduceat(bits, words.starts)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray     # [language, bucket]: log probability of a trigram
    forbidden: np.ndarray  # [language]: bits of the scripts that the language lacks

    def word_scores(self, words: Words) -> np.ndarray:
        """[word, language]; minus infinity where the script rules the language out,
        unless it rules out all."""
        n = len(words.starts)
        out = np.empty((n, len(self.languages)))
        first = 0
        while first < n:  # whole words, a bounded number of positions at a time
            last = max(first + 1, int(np.searchsorted(words.starts, words.starts[first] + POSITIONS)))
            end = words.starts[last] if last < n else len(words.letters)
            buckets = trigram_buckets(words.bytes, words.letters[words.starts[first]:end])
            cuts = words.starts[first:last] - words.starts[first]
            for k, table in enumerate(self.scores):
                out[first:last, k] = np.add.reduceat(table[buckets], cuts)
            first = last
        ruled_out = (word_scripts(words)[:, None] & self.forbidden[None, :]) != 0
        ruled_out &= ~ruled_out.all(axis=1, keepdims=True)
        out[ruled_out] = -np.inf
        return out


def _segments(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=np.int64)


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """The label of every word: the path of highest score of each text, where a change
    of label costs ``penalty``. Texts begin at ``starts``. Ties stay, then go to the
    first language.

    One label is the best path if no run of words gains more than the penalty under
    any other labels; the texts where some run does take the full recursion, all of
    them a word at a time.
    """
    n, k = scores.shape
    ends = np.r_[starts[1:], n]
    floor = np.where(np.isfinite(scores), scores, -1e6)  # a ruled-out word outweighs any run
    best = np.add.reduceat(floor, starts, axis=0).argmax(axis=1)
    labels = np.repeat(best, ends - starts)
    if k == 1:
        return labels
    rows = np.arange(n)
    own = floor[rows, labels]
    rest = floor.copy()
    rest[rows, labels] = -np.inf
    gain = rest.max(axis=1) - own
    # running sums with each text far below the one before it: the running minimum restarts
    total = np.cumsum(gain)
    depth = (total.max(initial=0) - total.min(initial=0) + 1) * 2
    index = np.repeat(np.arange(len(starts)), ends - starts)
    total = total - np.repeat(np.r_[0, total[ends - 1]][:-1], ends - starts)
    below = np.minimum.accumulate(np.minimum(total - gain, 0) - index * depth) + index * depth
    mixed = np.flatnonzero(np.maximum.reduceat(total - below, starts) > penalty)
    if not len(mixed):
        return labels
    order = mixed[np.argsort(-(ends - starts)[mixed], kind="stable")]
    begin, size = starts[order], (ends - starts)[order]
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # texts with a t-th word
    value = floor[begin].copy()
    stay, came = [], []
    for t in range(1, longest):
        a = active[t]
        top = value[:a].argmax(axis=1)
        change = value[np.arange(a), top] - penalty
        kept = value[:a] >= change[:, None]
        value[:a] = np.where(kept, value[:a], change[:, None]) + floor[begin[:a] + t]
        stay.append(kept)
        came.append(top.astype(np.int16))
    at = value.argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        a = active[t]
        labels[begin[:a] + t] = at[:a]
        at[:a] = np.where(stay[t - 1][np.arange(a), at[:a]], at[:a], came[t - 1])
    labels[begin] = at
    return labels


def train(docs: DataFrame, lang: str = "lang") -> LanguageModel:
    """Fit on all rows of ``docs`` with a text and a language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for step in steps(batches, "text"):
            by_lang: dict[str, list[bytes]] = {}
            for name, text in zip(values(step, "lang"), values(step, "text")):
                by_lang.setdefault(name, []).append(text)
            for name, texts in by_lang.items():
                words = split_words(texts)
                if name not in counts:
                    counts[name] = np.zeros(BUCKETS + len(SCRIPT_RANGES) + 1, dtype=np.int64)
                own = counts[name]
                for first in range(0, len(words.letters), POSITIONS):
                    own[:BUCKETS] += np.bincount(
                        trigram_buckets(words.bytes, words.letters[first:first + POSITIONS]), minlength=BUCKETS)
                scripts = word_scripts(words)
                for bit in range(len(SCRIPT_RANGES)):
                    own[BUCKETS + bit] += int(((scripts >> bit) & 1).sum())
                own[-1] += len(scripts)
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())],
                ["lang", "bucket", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col("text").cast("binary").alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL")
    # a row for each language and bucket: bounded by the number of languages
    summed = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toArrow()
    names = summed["lang"].to_pylist()
    languages = sorted(set(names))
    table = np.zeros((len(languages), BUCKETS + len(SCRIPT_RANGES) + 1))
    number = {name: i for i, name in enumerate(languages)}
    table[[number[x] for x in names], summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    counts = table[:, :BUCKETS] + SMOOTHING
    scores = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    lacking = table[:, BUCKETS:-1] < SCRIPT_SHARE * np.maximum(table[:, -1:], 1)
    forbidden = (lacking << np.arange(len(SCRIPT_RANGES))).sum(axis=1)
    # centred: a trigram that is as likely in all languages scores zero
    return LanguageModel(languages, (scores - scores.mean(axis=0)).astype(np.float32) if languages else scores,
                         forbidden.astype(np.uint16))


_LETTER = regex.compile(r"\p{L}")


def _has_letter(text: bytes | None) -> bool:
    return bool(text) and _LETTER.search(text.decode()) is not None


def label(texts: list[bytes | None], model: LanguageModel, penalty: float = SWITCH_PENALTY
          ) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """``(language, share of the letter bytes, spans)`` of each text; a span is (first
    word, word after the last, language)."""
    words = split_words(texts)
    nothing: list[tuple[str, float, list]] = [(UNDETERMINED, 0.0, []) for _ in texts]
    if not len(words.starts) or not model.languages:
        return nothing
    starts = _segments(words.owner)
    labels = viterbi(model.word_scores(words), starts, penalty)
    texts_found = words.owner[starts]
    k = len(model.languages)
    held = np.bincount(words.owner * k + labels, weights=words.lengths, minlength=len(texts) * k).reshape(-1, k)
    head = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (words.owner[1:] != words.owner[:-1])])
    last = np.r_[head[1:], len(labels)]
    origin = np.repeat(starts, np.diff(np.r_[starts, len(labels)]))
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for text, a, b, one in zip(words.owner[head].tolist(), (head - origin[head]).tolist(),
                               (last - origin[head]).tolist(), labels[head].tolist()):
        spans[text].append((a, b, model.languages[one]))
    winner, share = held.argmax(axis=1), held.max(axis=1) / np.maximum(held.sum(axis=1), 1)
    out = nothing
    for i in texts_found.tolist():
        if _has_letter(texts[i]):
            out[i] = (model.languages[winner[i]], float(share[i]), spans[i])
    return out


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",),
             penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The ``keep`` columns, ``lang_pred``, ``score`` (share of the letter bytes in its
    spans) and ``spans`` of every row.

    Null texts and texts without a letter get ``und``, score 0 and no spans, and so do
    all texts if no language was learned. Equal shares go to the language that sorts
    first. Repeated rows are labelled each; columns besides ``keep`` and ``text`` are
    not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, BODY):
            found = label(values(step, BODY), shipped.value, penalty)
            yield pa.RecordBatch.from_arrays(
                [*(step.column(i) for i in range(step.num_columns - 1)), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64()),
                 pa.array([[{"first": a, "last": b, "lang": c} for a, b, c in x[2]] for x in found], span)],
                [*step.schema.names[:-1], "lang_pred", "score", "spans"])

    narrow = docs.select(*keep, F.col("text").cast("binary").alias(BODY))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(
        run, f"{keys}, lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out))
    return identify(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out")).select(
        "doc_id", "held_out", "lang_pred", "score", "spans")
