"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade <= k | x) = sigmoid(threshold_k - w . x): one weight vector is shared by all
ordered thresholds. A document's features are the distinct words it has of a learned
vocabulary. The expected severity is the sum over k of P(grade > k).

Fitting uses a bounded, seeded sample of the labelled rows (``SAMPLE_PER_GRADE`` a
grade), with as much weight on the lowest grade as on all others, so that few toxic
labels don't pull every probability down; scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesoro.llm.common import BODY, prepare, read, shared_uri, steps, values

# Labelled rows of each grade that the fit may use, and the features it may keep:
# the bounds of what reaches the driver.
SAMPLE_PER_GRADE = 6_000
VOCABULARY = 8_192
# A word must be in so many sample documents to become a feature.
MIN_DOCUMENTS = 3
# Least log-likelihood ratio of a feature (half a chi-square of one degree: p < 0.0001).
LEAST_TELLING = 7.6
FIT_STEPS = 300
RIDGE = 0.5  # divided by the number of sample documents
# A document is rejected if its probability of a grade above 0 reaches this.
REJECT_AT = 0.5

# A-Z in lower case; digits, letters and all bytes of other characters stay; the rest
# separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def features(text: bytes | None) -> set[bytes]:
    """The distinct words of a text."""
    return set((text or b"").translate(WORD_BYTES).split())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class OrdinalModel:
    """Grade k is ``grades[k]``; ``thresholds`` has one entry fewer, ascending."""
    grades: list[int]
    thresholds: np.ndarray
    weights: dict[bytes, float]

    def above(self, text: bytes | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        score = sum(map(self.weights.__getitem__, features(text) & self.weights.keys()))
        return _sigmoid(score - self.thresholds)


def fit_cumulative_link(rows: np.ndarray, features: np.ndarray, grade: np.ndarray, weight: np.ndarray,
                        n_grades: int, n_features: int, ridge: float = RIDGE,
                        steps_: int = FIT_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weighted ridge maximum likelihood by Adam with full gradients.

    ``(rows, features)`` are the coordinates of the ones of the sparse feature matrix,
    ``grade`` is 0..n_grades-1. Thresholds are kept in order by learning the first and
    the logarithms of the gaps. Returns (weights, thresholds).
    """
    n, k = len(grade), n_grades - 1
    share = weight / weight.sum()
    below = np.array([(share * (grade <= j)).sum() for j in range(k)]).clip(1e-6, 1 - 1e-6)
    start = np.log(below / (1 - below))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    at = np.r_[np.zeros(n_features), start[:1], gaps]
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for t in range(1, steps_ + 1):
        w, first, gaps = at[:n_features], at[n_features], at[n_features + 1:]
        theta = first + np.r_[0, np.cumsum(np.exp(gaps))]
        score = np.bincount(rows, weights=w[features], minlength=n)
        edge = np.c_[np.full(n, -np.inf), theta[None, :] - score[:, None], np.full(n, np.inf)]
        cdf = _sigmoid(edge)
        slope = cdf * (1 - cdf)
        high, low = cdf[np.arange(n), grade + 1], cdf[np.arange(n), grade]
        probability = np.maximum(high - low, 1e-12)
        up, down = slope[np.arange(n), grade + 1], slope[np.arange(n), grade]
        by_score = share * (up - down) / probability  # of minus the log-likelihood
        by_theta = np.zeros(k)
        np.add.at(by_theta, np.minimum(grade, k - 1), np.where(grade < k, -share * up / probability, 0))
        np.add.at(by_theta, np.maximum(grade - 1, 0), np.where(grade > 0, share * down / probability, 0))
        tail = np.cumsum(by_theta[::-1])[::-1]
        gradient = np.r_[np.bincount(features, weights=by_score[rows], minlength=n_features) + ridge / n * w,
                         tail[0], tail[1:] * np.exp(gaps)]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient ** 2
        at = at - 0.1 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.999 ** t)) + 1e-8)
    w, first, gaps = at[:n_features], at[n_features], at[n_features + 1:]
    return w, first + np.r_[0, np.cumsum(np.exp(gaps))]


def _sample(docs: DataFrame, labels: DataFrame, grade: Column, per_grade: int) -> DataFrame:
    """``(grade, share, text)`` of a bounded sample: about ``per_grade`` labelled
    documents of each grade, picked by a hash of the id; a document's grade is its
    highest label's."""
    graded = (labels.select(F.col("doc_id").alias("doc_id"), grade.cast("int").alias("grade"))
                    .where("doc_id IS NOT NULL AND grade IS NOT NULL")
                    .groupBy("doc_id").agg(F.max("grade").alias("grade")))
    counts = {r["grade"]: r["n"] for r in graded.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs.select(F.lit(0).alias("grade"), F.lit(1.0).alias("share"), "text").where(F.lit(False))
    fraction = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, per_grade / n))])
    place = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30))
    taken = (graded.withColumn("fraction", fraction[F.col("grade")]).where(place < F.col("fraction"))
                   .select("doc_id", "grade", (1 / F.col("fraction")).alias("share")))
    # bounded by per_grade rows a grade
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("grade", "share", "text")


def _word_rows(sample: DataFrame) -> DataFrame:
    """``(row, grade, share, words)``: the distinct words of every sample document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            found = [sorted(features(t)) for t in values(step, "text")]
            yield pa.RecordBatch.from_arrays(
                [step.column(0), step.column(1), pa.array(found, pa.list_(pa.binary()))], ["grade", "share", "words"])
    return sample.select("grade", "share", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "grade int, share double, words array<binary>")


def fit(docs: DataFrame, labels: DataFrame, grade: Column, per_grade: int = SAMPLE_PER_GRADE,
        vocabulary: int = VOCABULARY, min_documents: int = MIN_DOCUMENTS,
        least: float = LEAST_TELLING, balance: bool = True) -> OrdinalModel:
    """Fit on the sample. The vocabulary is the words whose presence tells most about
    a grade above the lowest (largest weighted log-likelihood ratio); ties go to the
    smaller word. ``balance`` gives the lowest grade as much weight as all others. With
    one grade only, every document gets it.

    Null texts count as empty; labels without a document and null grades are ignored;
    without a usable label the model has no grades and ``score`` gives nulls.
    """
    spark = docs.sparkSession
    uri = shared_uri(spark, "toxicity-sample")
    _word_rows(_sample(docs, labels, grade, per_grade)).write.parquet(uri)
    sample = spark.read.parquet(uri)
    totals = {r["grade"]: r["s"] for r in sample.groupBy("grade").agg(F.sum("share").alias("s")).collect()}
    if not totals:
        return OrdinalModel([], np.zeros(0), {})
    grades = sorted(totals)
    if len(grades) == 1:
        return OrdinalModel(grades, np.zeros(0), {})
    n_high = sum(s for g, s in totals.items() if g > grades[0])
    n_low = totals[grades[0]]
    high = F.col("grade") > grades[0]
    counted = (sample.select("grade", "share", F.explode("words").alias("word")).groupBy("word")
               .agg(F.count("*").alias("n"), F.sum(F.when(high, F.col("share")).otherwise(0.0)).alias("a"),
                    F.sum(F.when(high, 0.0).otherwise(F.col("share"))).alias("b"))
               .where(F.col("n") >= min_documents))

    def term(part: Column, whole: Column) -> Column:
        return F.when(part > 0, part * F.log(part / whole)).otherwise(0.0)
    rate = (F.col("a") + F.col("b")) / (n_high + n_low)
    telling = (term(F.col("a"), n_high * rate) + term(F.col("b"), n_low * rate)
               + term(n_high - F.col("a"), n_high * (1 - rate)) + term(n_low - F.col("b"), n_low * (1 - rate)))
    chosen = [bytes(r["word"]) for r in counted.select("word", telling.alias("g")).where(F.col("g") >= least)
              .orderBy(F.desc("g"), "word").limit(vocabulary).collect()]
    number = {w: i for i, w in enumerate(chosen)}
    known = spark.sparkContext.broadcast(number)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            found = [[i for w in ws if (i := get(w)) is not None] for ws in values(batch, "words")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))],
                                             ["grade", "share", "features"])
    rows = sample.mapInArrow(numbered, "grade int, share double, features array<int>").toArrow()
    rows = rows.combine_chunks()
    lists = rows["features"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    at = np.repeat(np.arange(len(lengths)), lengths)
    index = lists.flatten().to_numpy().astype(np.int64)
    level = {g: i for i, g in enumerate(grades)}
    grade_of = np.array([level[g] for g in rows["grade"].to_pylist()])
    weight = rows["share"].to_numpy() / np.where(grade_of == 0, n_low, n_high) if balance else rows["share"].to_numpy()
    w, thresholds = fit_cumulative_link(at, index, grade_of, weight, len(grades), len(chosen))
    return OrdinalModel(grades, thresholds, {word: float(w[i]) for word, i in number.items() if w[i]})


def score(docs: DataFrame, model: OrdinalModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``severity`` (expected grade), ``p_toxic`` (probability of
    a grade above the lowest) and ``grade`` (the most probable) of every row. Null
    texts count as empty; repeated rows are scored each. A model without grades gives
    nulls."""
    if not model.grades:
        return docs.select(*keep, *[F.lit(None).cast(kind).alias(c) for c, kind in (
            ("severity", "double"), ("p_toxic", "double"), ("grade", "int"))])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        grades = np.array(model.grades, dtype=np.float64)
        for step in steps(batches, BODY):
            severity, p_toxic, grade = [], [], []
            for text in values(step, BODY):
                above = model.above(text)
                each = -np.diff(np.r_[1.0, above, 0.0])
                severity.append(float(each @ grades))
                p_toxic.append(float(above[0]) if len(above) else float(model.grades[0] > 0))
                grade.append(model.grades[int(each.argmax())])
            yield pa.RecordBatch.from_arrays(
                [*(step.column(i) for i in range(step.num_columns - 1)), pa.array(severity), pa.array(p_toxic),
                 pa.array(grade, pa.int32())], [*step.schema.names[:-1], "severity", "p_toxic", "grade"])

    narrow = docs.select(*keep, F.col("text").cast("binary").alias(BODY))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{keys}, severity double, p_toxic double, grade int")


def label_grade() -> Column:
    """Grade of a ``labels`` row: 0 not toxic, 1 toxic, 2 toxic and of bad quality."""
    return F.when(F.col("toxic") == 0, 0).when((F.col("toxic") > 0) & (F.col("quality") == 0), 2).when(
        F.col("toxic") > 0, 1)


def drop_toxic(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """``docs`` without the documents whose probability of a grade above the lowest
    is ``reject_at`` or more; without a usable label all stay. All columns pass through,
    whatever their names."""
    model = fit(docs, labels, label_grade())
    scored = score(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), model, keep=("_doc",))
    return scored.where(F.col("p_toxic").isNull() | (F.col("p_toxic") < reject_at)).select(
        *[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, fitted on ``labels``."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), label_grade())
    return score(docs, model).withColumn("toxic", F.col("p_toxic") >= REJECT_AT)
