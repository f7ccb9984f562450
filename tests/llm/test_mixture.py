import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesoro.llm import mixture as X
from tesoro.llm.common import prepare


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 200), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 60)), min_size=1, max_size=6))
def test_siblings_share_by_weight_within_their_capacity(budget, wants):
    wants = [(Fraction(w), c) for w, c in wants]
    given_ = X._share(budget, wants)
    assert sum(given_) == min(budget, sum(c for _, c in wants))
    assert all(0 <= g <= c for g, (_, c) in zip(given_, wants))
    open_ = [(g, w) for g, (w, c) in zip(given_, wants) if w and g < c]
    for a, w in open_:  # what is not full is in proportion, to a token
        for b, x in open_:
            assert abs(Fraction(a) / w - Fraction(b) / x) <= Fraction(1, 1) / w + Fraction(1, 1) / x
        for (g, (x, c)) in zip(given_, wants):
            if x and g == c:  # a full one got no more than its share
                assert Fraction(g) / x <= Fraction(a + 1) / w


def test_a_shortage_goes_to_siblings_before_ancestors():
    available = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "1"): 1000, ("b", "z", "1"): 1000}
    weights = {("a",): 1, ("b",): 1, ("a", "x", "1"): 1, ("a", "x", "2"): 1}
    got = X.budgets(available, 400, weights)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "1"): 100, ("b", "z", "1"): 200}
    available[("a", "x", "2")] = 20  # the family is short: its siblings take over, still within "a"
    assert X.budgets(available, 400, weights) == {
        ("a", "x", "1"): 10, ("a", "x", "2"): 20, ("a", "y", "1"): 170, ("b", "z", "1"): 200}
    available[("a", "y", "1")] = 30  # the whole domain is short
    assert X.budgets(available, 400, weights)[("b", "z", "1")] == 340
    assert X.budgets(available, 400, weights, max_epochs=2)[("a", "x", "2")] == 40
    assert X.budgets({}, 10, {}) == {}


def documents(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        source = "s%d" % (0 if rng.random() < 0.5 else rng.randrange(9))
        rows.append((i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "en", "de", None]), source, "x"))
    rows += [(5000, None, "en", "s1", "x"), (5001, "", "en", None, "x"), (None, "no id here", "en", "s2", "x"),
             (5002, "w " * 30000, "fr", "odd", "x"), (7, "same row", "de", "s3", "x"), (7, "same row", "de", "s3", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digit string").repartition(5)


def leaf(row):
    number = row["source"] or ""
    digits = number[1:] if number[:1] == "s" else ""
    return (X.DOMAINS[int(digits or 0) % 4], row["lang"] or X.NONE, row["source"] or X.NONE)


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.9, 3)])
def test_every_leaf_takes_its_budget_in_whole_epochs_and_a_prefix(spark, share, epochs):
    prepare(spark)
    docs = documents(spark)
    rows = docs.collect()
    size = lambda r: len((r["text"] or "").split())
    available, longest = Counter(), defaultdict(int)
    for r in rows:
        available[leaf(r)] += size(r)
        longest[leaf(r)] = max(longest[leaf(r)], size(r) * sum(x == r for x in rows))
    budget = X.budgets(available, int(share * sum(available.values())), X.WEIGHTS, epochs)
    found = X.mix(docs, budget_share=share, max_epochs=epochs)
    assert found.columns == [*docs.columns, "_epoch"]
    taken, times = Counter(), Counter()
    for r in found.collect():
        assert r["_epoch"] < epochs
        taken[leaf(r)] += size(r)
        times[(r["doc_id"], r["text"], r["lang"], r["source"], r["digit"])] += 1
    for name, tokens in budget.items():
        assert tokens <= taken[name] < tokens + max(1, longest[name]) or tokens == 0 == taken[name]
    for r in rows:  # a leaf's documents are there whole times, or once more
        whole = budget[leaf(r)] // available[leaf(r)] if available[leaf(r)] else 0
        assert times[tuple(r)] // sum(x == r for x in rows) in (whole, whole + 1)


def test_the_same_seed_chooses_the_same_rows_under_any_partitioning(spark):
    prepare(spark)
    docs = documents(spark)
    key = lambda df: sorted(map(str, df.collect()))
    one, two = X.mix(docs.repartition(1)), X.mix(docs.repartition(9))
    assert key(one) == key(two) != key(X.mix(docs, seed=99))


def test_the_cut_is_found_through_all_digits(spark, monkeypatch):
    prepare(spark)
    docs = documents(spark).where("text IS NOT NULL")
    monkeypatch.setattr(X, "DIGIT_BITS", 2)
    few = sorted((r["doc_id"] or -1, r["_epoch"]) for r in X.mix(docs).collect())
    monkeypatch.setattr(X, "DIGIT_BITS", 10)
    assert few == sorted((r["doc_id"] or -1, r["_epoch"]) for r in X.mix(docs).collect())


def test_empty_and_too_many_leaves(spark, monkeypatch):
    prepare(spark)
    docs = documents(spark)
    assert X.mix(docs.limit(0)).count() == 0
    monkeypatch.setattr(X, "MAX_LEAVES", 3)
    with pytest.raises(ValueError):
        X.mix(docs)


def test_query_takes_whole_rows_of_the_table(spark):
    found = X.op8_mixture(spark, "/root/testdata/sf0.01")
    ids = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert found.join(ids, "doc_id", "left_anti").count() == 0
    assert 0 < found.where(F.col("epoch") == 0).count() <= ids.count()


def test_a_column_named_like_the_epochs(spark):
    prepare(spark)
    docs = documents(spark)
    named = docs.withColumn("_epoch", F.lit("own")).withColumn("__Epoch", F.lit("own too"))
    found = X.mix(named)
    assert found.columns == [*named.columns, "___epoch"] and X.epoch_column(docs) == "_epoch"
    assert found.where("_epoch <> 'own' OR __Epoch <> 'own too'").count() == 0
    assert found.count() == X.mix(docs).count()
    assert X.mix(named, max_epochs=1).select(*named.columns).columns == named.columns
