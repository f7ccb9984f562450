"""T4 in two times: the rule set in force on a date, as known at a time."""
import datetime as dt
import random

import pytest

from tesoro.operators import tax

SETS = ("id string, jurisdiction string, effective_date date, published_gazette_ref string, status string, notes string, "
        "created_at timestamp, published_by string, published_at timestamp")
ASKED = "n long, jur string, as_of date, known timestamp"


def rule_sets(spark, rows):
    return spark.createDataFrame([(i, j, e, "", s, "", None, "", p) for i, j, e, s, p in rows], SETS)


def brute(rows, asked):
    out = []
    for n, jur, as_of, known in asked:
        seen = [(e, p, i) for i, j, e, s, p in rows if s in tax.HISTORY_STATUSES and None not in (e, p, as_of, known)
                and j == jur and e <= as_of and p <= known]
        out.append((n, max(seen)[2] if seen else None, max(seen)[0] if seen else None))
    return sorted(out)


def ask(spark, rows, asked, **options):
    out = tax.as_known_rule_set(spark.createDataFrame(asked, ASKED), rule_sets(spark, rows), "as_of", "known", "jur", **options)
    return sorted((r["n"], r["rule_set_id"], r["rule_set_effective_date"]) for r in out.collect())


@pytest.mark.parametrize("seed,count", [(1, 0), (2, 12), (3, 60)])
def test_matches_brute_force(spark, seed, count, monkeypatch):
    rng = random.Random(seed)
    day = lambda: dt.date(1996, 1, 1) + dt.timedelta(rng.randint(0, 2500))
    time = lambda: dt.datetime.combine(day(), dt.time(rng.randint(0, 3)))
    rows = [(f"s{i}", rng.choice(["MX", "US"]), rng.choice([day(), dt.date(1999, 1, 1)]),
             rng.choice(["active", "superseded", "superseded", "draft"]), rng.choice([time(), dt.datetime(2000, 1, 1)])) for i in range(count)]
    rows += [("no date", "MX", None, "active", time()), ("no time", "MX", day(), "active", None)]
    asked = [(n, rng.choice(["MX", "US", "XX"]), day(), time()) for n in range(300)]
    asked += [(900, None, day(), time()), (901, "MX", None, time()), (902, "MX", day(), None)]
    want = brute(rows, asked)
    assert ask(spark, rows, asked) == want
    if seed == 3:  # more sets than are broadcast: the same by a shuffle join
        monkeypatch.setattr(tax, "MAX_RULE_ROWS", 5)
        assert ask(spark, rows, asked) == want


def test_a_later_publication_changes_no_earlier_answer(spark):
    rows = [("old", "MX", dt.date(2020, 1, 1), "superseded", dt.datetime(2019, 12, 1)),
            ("new", "MX", dt.date(2021, 1, 1), "active", dt.datetime(2021, 1, 1))]
    asked = [(n, "MX", dt.date(2020, 1, 1) + dt.timedelta(30 * n), dt.datetime(2021, 6, 1)) for n in range(30)]
    before = ask(spark, rows, asked)
    late = [("retroactive", "MX", dt.date(2020, 6, 1), "active", dt.datetime(2022, 1, 1)),
            ("replacement", "MX", dt.date(2021, 1, 1), "active", dt.datetime(2022, 1, 2))]
    assert ask(spark, rows + late, asked) == before
    assert ask(spark, rows + late, [(*a[:3], dt.datetime(2023, 1, 1)) for a in asked]) != before


def test_rectangles_stay_linear():
    sets = [(f"s{i}", dt.date(2000, 1, 1) + dt.timedelta(i * 37 % 1000), dt.datetime(2000, 1, 1) + dt.timedelta(i)) for i in range(1000)]
    assert len(tax._known_rectangles(sets)) <= 3 * len(sets)
