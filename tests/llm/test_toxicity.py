import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesoro.llm import toxicity as X
from tesoro.llm.common import prepare


def test_gradient_reaches_the_maximum():
    """At the fitted point the penalised likelihood falls in every direction."""
    rng = np.random.default_rng(0)
    n, features, grades = 400, 6, 3
    x = rng.random((n, features)) < 0.4
    latent = x @ np.array([2.0, -1.0, 0.5, 0.0, 1.0, 0.0]) + rng.logistic(size=n)
    grade = np.digitize(latent, [0.5, 2.5])
    rows, cols = np.nonzero(x)
    weight = rng.uniform(0.5, 1.5, n)
    w, theta = X.fit_cumulative_link(rows, cols, grade, weight, grades, features, ridge=1.0, steps_=2000)
    assert theta[0] < theta[1]

    def loss(w, theta):
        edge = np.c_[np.full(n, -np.inf), theta[None, :] - (x @ w)[:, None], np.full(n, np.inf)]
        cdf = 1 / (1 + np.exp(-edge))
        p = cdf[np.arange(n), grade + 1] - cdf[np.arange(n), grade]
        return -(weight / weight.sum() * np.log(p)).sum() + 0.5 / n * (w ** 2).sum()
    best = loss(w, theta)
    for i in range(features + 2):
        for step in (-0.02, 0.02):
            at = np.r_[w, theta]
            at[i] += step
            assert loss(at[:features], at[features:]) > best
    assert w[0] > 1 and w[1] < 0


def tables(spark):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(400):
        words = ["w%d" % k for k in rng.integers(0, 60, 30)]
        grade = int(rng.choice([0, 0, 0, 1, 2]))
        words += ["rude"] * (grade > 0) + ["vile"] * (grade > 1)
        docs.append((i, " ".join(rng.permutation(words)), "a", 0.5))
        labels.append((i, 0 if grade == 2 else 1, int(grade > 0)))
    docs += [(None, "rude", "b", 0.0), (1000, None, "b", 0.0), (1001, "", "b", 0.0), (1002, "RUDE!! vile." + " w1" * 30000, "b", 0.0),
             (1003, "w1 w2 w3", "b", 0.0), (1003, "w1 w2 w3", "b", 0.0)]
    labels += [(5000, 1, 1), (None, 1, 1), (1003, None, None), (3, 1, None), (4, None, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, grade string, severity double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_grades_thresholds_and_odd_rows(spark):
    prepare(spark)
    docs, labels = tables(spark)
    model = X.fit(docs, labels, X.label_grade())
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    assert model.weights[b"rude"] > 0.5 and model.weights[b"vile"] > 0.5
    found = X.score(docs, model, keep=("doc_id", "text")).collect()
    assert len(found) == docs.count()
    by_text = {(r["doc_id"], r["text"]): r for r in found}
    assert by_text[(1002, docs.where("doc_id = 1002").first()["text"])]["grade"] == 2
    assert by_text[(None, "rude")]["p_toxic"] > 0.5
    for key in ((1000, None), (1001, ""), (1003, "w1 w2 w3")):
        assert by_text[key]["p_toxic"] < 0.5 and by_text[key]["severity"] < 1
    for r in found:
        assert 0 <= r["severity"] <= 2
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("text LIKE '%rude%'").count() == 0
    assert kept.where("doc_id = 1003").count() == 2 and kept.where("text IS NULL").count() == 1
    assert X.score(docs.limit(0), model).count() == 0


def test_one_grade_and_no_labels(spark):
    prepare(spark)
    docs, labels = tables(spark)
    only = X.fit(docs, labels.where("toxic = 0"), X.label_grade())
    assert only.grades == [0] and X.score(docs, only).agg(F.max("p_toxic")).first()[0] == 0.0
    for none in (labels.limit(0), labels.where("doc_id = 5000"), labels.where("toxic IS NULL")):
        found = X.score(docs, X.fit(docs, none, X.label_grade()), keep=("doc_id", "text"))
        assert found.count() == docs.count()
        assert found.where("severity IS NOT NULL OR p_toxic IS NOT NULL OR grade IS NOT NULL").count() == 0
        assert sorted(map(str, X.drop_toxic(docs, none).collect())) == sorted(map(str, docs.collect()))


def test_query_scores_by_the_formula(spark):
    """Every document of the given table, by words, weights and thresholds one by one."""
    sf = "/root/testdata/sf0.01"
    prepare(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = X.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), X.label_grade())
    want = {}
    for r in docs.select("doc_id", "text").collect():
        lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r["text"] or "").encode())
        total = sum(model.weights.get(w, 0.0) for w in set(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)))
        above = [1.0, *(1 / (1 + math.exp(t - total)) for t in model.thresholds), 0.0]
        want[r["doc_id"]] = (sum(g * (above[k] - above[k + 1]) for k, g in enumerate(model.grades)), above[1])
    got = {r["doc_id"]: r for r in X.op4_toxicity(spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, (severity, p_toxic) in want.items():
        assert got[i]["severity"] == pytest.approx(severity, abs=1e-6) and got[i]["p_toxic"] == pytest.approx(p_toxic, abs=1e-6)
        assert got[i]["toxic"] == (got[i]["p_toxic"] >= 0.5)


def test_held_out_labels_of_the_given_tables(spark):
    prepare(spark)
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = X.fit(docs, labels.where("doc_id % 2 = 0"), X.label_grade())
    found = {(r["toxic"], r["hit"]): r["n"] for r in X.score(docs, model).join(
        labels.where("doc_id % 2 = 1"), "doc_id").groupBy("toxic", (F.col("p_toxic") >= X.REJECT_AT).alias("hit")).agg(
        F.count("*").alias("n")).collect()}
    assert found.get((0, True), 0) <= 0.01 * found[(0, False)]   # clean documents are left alone
    assert found[(1, True)] >= 0.65 * (found[(1, True)] + found.get((1, False), 0))
