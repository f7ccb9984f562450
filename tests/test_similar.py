"""The similarity join against all pairs."""
import datetime as dt
import random

import pytest

from tesoro.operators.similar import fuzzy_duplicates, similar_pairs

COLUMNS = "transaction_id long, account_id long, transaction_date date, description string, confidence_score double, day long"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, days, distance):
    out = []
    for i, (tid, account, day, text, *_) in enumerate(rows):
        scores = []
        for j, (_, other, day2, text2, *_) in enumerate(rows):
            if i != j and None not in (account, day, text, day2, text2) and account == other and abs((day - day2).days) <= days:
                n = edits(text, text2)
                if n <= distance:
                    scores.append(1.0 - n / max(len(text), len(text2), 1))
        out.append((tid, max(scores, default=None), len(scores)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,days,distance", [(1, 3, 1), (2, 0, 2), (3, 5, 3), (4, 2, 0)])
def test_matches_all_pairs(spark, seed, days, distance):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(12)] + ["", "a", "pago de renta", "漢字"]

    def text():
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t[at:at + rng.randint(0, 1)] = [rng.choice("abx")] * rng.randint(0, 1)
        return "".join(t)
    day = lambda: dt.date(1969, 12, 25) + dt.timedelta(rng.randint(0, 14))
    rows = [(i, rng.choice([1, 1, 2]), day(), text(), None, 7) for i in range(160)]
    rows += [(500, None, day(), "a", None, 7), (501, 1, None, "a", None, 7), (502, 1, day(), None, None, 7)]
    rows += rows[:5]  # repeated rows
    got = fuzzy_duplicates(spark.createDataFrame(rows, COLUMNS).repartition(3), days, distance)
    assert sorted([(r["transaction_id"], r["confidence_score"], r["n_similar"]) for r in got.collect()], key=repr) \
        == brute(rows, days, distance)


def test_a_hot_description_is_not_expanded_into_pairs(spark):
    """A third of all rows are copies of one text on one day: one node, counted."""
    rows = spark.range(30_000).selectExpr(
        "id AS transaction_id", "1L AS account_id", "date'2024-01-01' + cast(id % 3 AS int) * 40 AS transaction_date",
        "IF(id % 3 = 0, 'monthly rent', concat('invoice ', id * 1000003)) AS description",
        "cast(NULL AS double) AS confidence_score")
    out = fuzzy_duplicates(rows, 3, 1)
    hot = out.where("description = 'monthly rent'").agg({"n_similar": "min", "confidence_score": "min"}).first()
    assert tuple(hot) in ((9999, 1.0), (1.0, 9999))
    assert out.count() == 30_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_empty_table(spark):
    assert fuzzy_duplicates(spark.createDataFrame([], COLUMNS)).collect() == []


def test_days_meet_across_blocks_and_the_keys_are_shuffled_once(spark):
    rows = [(2 * i + late, i, dt.date(2024, 1, 1) + dt.timedelta(i + late * 3), "invoice 1" + "7" * late, None, 7)
            for i in range(40) for late in (0, 1)]
    rows += [(100, 90, dt.date(2024, 1, 1), "invoice 1", None, 7), (101, 90, dt.date(2024, 1, 5), "invoice 17", None, 7)]  # four days
    nodes = spark.createDataFrame(rows, COLUMNS).selectExpr("account_id", "transaction_date", "description", "1L AS copies")
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        pairs = similar_pairs(nodes, 3, 1)
        found = sorted(r["account_id"] for r in pairs.collect())
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert found == list(range(40))
    assert "ReusedExchange" in plan
